"""A lakehouse analytics library on PySpark: DataFrame operators, data-quality suites, and batch jobs."""
