"""Source-code corpus analytics on PySpark DataFrames."""
