"""plotline: place-register and corpus analytics written as Spark DataFrame jobs."""

__version__ = "0.1.0"
