"""Market-bar analytics on Spark: DataFrame in, DataFrame out."""

from barloom.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
