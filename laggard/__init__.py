"""laggard: learning on streams with missing cells and late labels, on Spark."""

__version__ = "0.1.0"
