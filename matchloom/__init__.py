"""matchloom: document matching and text classification as PySpark DataFrame operators."""

__version__ = "0.1.0"
