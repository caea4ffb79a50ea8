"""artiscope: static analysis of software artifacts and text tables on Spark DataFrames."""

__version__ = "0.1.0"
