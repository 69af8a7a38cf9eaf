"""Photosensitive-flash analytics over image time-series, as Spark DataFrames."""
