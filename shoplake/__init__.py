"""shoplake: Spark jobs for retail behaviour data, as functions from DataFrames to DataFrames."""
