"""Citation analytics over document corpora as PySpark DataFrames."""
