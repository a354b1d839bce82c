"""Full-text search, link analysis and crawl control on PySpark DataFrames."""

__version__ = "0.1.0"
