"""Feed files, topics and event tables as DataFrames."""
