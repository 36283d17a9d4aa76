"""gridloom: point-set analytics as ordinary Spark DataFrames."""
