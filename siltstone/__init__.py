"""siltstone: Spark-native findings analytics over source trees, and a training-data toolkit in ``siltstone.llm``."""

__version__ = "0.1.0"
