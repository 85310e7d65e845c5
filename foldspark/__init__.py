"""Walk-forward research engine on Spark DataFrames."""
