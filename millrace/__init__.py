"""Log analytics on Spark: a YAML log program compiled to DataFrame expressions, plus operators for preparing text data."""

__version__ = "0.1.0"
