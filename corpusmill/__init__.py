"""corpusmill: text-benchmark analytics as lazy PySpark DataFrame plans."""

__version__ = "0.1.0"
