"""millrace - site search, retrieval analytics and crawl data processing on PySpark."""

__version__ = "0.1.0"
