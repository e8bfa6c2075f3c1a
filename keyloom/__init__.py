"""keyloom: keyed-record dictionaries and their catalogues as Spark DataFrames."""

__version__ = "0.1.0"
