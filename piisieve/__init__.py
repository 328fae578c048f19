"""piisieve: PySpark-native tables for finding, scoring and removing personal data in text.

Every public operator is a function ``DataFrame -> DataFrame`` built from Spark's
native expressions, joins, aggregates and windows.
"""

__version__ = "0.1.0"
