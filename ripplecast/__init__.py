"""ripplecast: code change-impact analytics and corpus operators on PySpark."""

__version__ = "0.1.0"
