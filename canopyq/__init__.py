"""canopyq: forest, terrain and corpus analytics expressed as Spark DataFrames."""

__version__ = "0.1.0"
