"""tablelens: data profiling and quality scoring as Spark DataFrame jobs."""

__version__ = "0.1.0"
