"""tessera: catalogue and corpus processing on Spark DataFrames."""
