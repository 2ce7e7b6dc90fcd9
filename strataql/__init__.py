"""strataql: an embedded-SQL dialect and data-processing operators on Apache Spark."""

__version__ = "0.1.0"
