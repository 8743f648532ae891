"""Credit-risk features, scoring, drift and review analytics as Spark jobs."""

__version__ = "0.1.0"
