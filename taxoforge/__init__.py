"""A PySpark engine that refines large knowledge graphs."""
