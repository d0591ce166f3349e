"""tidemill: spec-driven cleaning of tabular data as one lazily evaluated Spark plan."""

__version__ = "0.1.0"
