"""Analytics over source code, configuration and web text, and over corpora at scale, on Spark DataFrames."""
