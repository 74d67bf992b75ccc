"""rastra: gridded geospatial analytics as Spark DataFrames, with operators for preparing training text."""
