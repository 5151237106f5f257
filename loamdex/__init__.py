"""loamdex: a document-corpus index, search and data-preparation engine on Spark DataFrames."""

__version__ = "0.1.0"
