"""skein: search, analytics and data preparation over conversation transcripts, on Spark."""

__version__ = "0.1.0"
