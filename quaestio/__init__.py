"""quaestio — question analytics for large collections of short multilingual posts, on Spark."""

__version__ = "0.1.0"
