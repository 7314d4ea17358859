"""regframe: multi-level dataset assembly and regression statistics as Spark jobs."""

__version__ = "0.1.0"
