"""Story intelligence on PySpark: feeds, items, stories, articles and their views."""

__version__ = "0.1.0"
