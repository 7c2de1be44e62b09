"""pagemill: a Spark-native engine that turns web pages into clean, content-addressed documents."""

__version__ = "0.1.0"
