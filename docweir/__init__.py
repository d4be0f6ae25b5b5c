"""docweir - documentation corpora on Spark: plan crawls, extract, chunk, index, search, converse."""

__version__ = "0.1.0"
