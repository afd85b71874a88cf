"""Event-locked analysis of multichannel time series on Spark DataFrames."""
