"""Declarative data quality: suites in YAML, checks, and a runner that fuses the row checks of a table into one pass."""
