"""Reading and writing: lake tables, files, databases, paged services, and generators of test sources."""
