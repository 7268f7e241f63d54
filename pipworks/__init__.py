"""Analytics over collections of recorded backgammon matches, on Spark."""

__version__ = "0.1.0"
