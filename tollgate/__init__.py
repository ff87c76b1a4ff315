"""tollgate: road-traffic assignment analytics expressed as Spark DataFrames."""
