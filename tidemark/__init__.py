"""tidemark: ordered time-series, panel and tabular analytics on PySpark DataFrames."""
