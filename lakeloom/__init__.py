"""DataFrame analytics, built from small functions of DataFrames."""
