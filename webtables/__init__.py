"""Tables about websites, built from captured pages with Spark DataFrames."""
