"""A PySpark engine for querying, transforming and validating collections of XML documents."""
