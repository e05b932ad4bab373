"""Search-demand analytics on Spark: ingest, resolve, roll up and chart."""
