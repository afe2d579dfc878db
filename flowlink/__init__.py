"""Record integration on Spark: read events once, map, link, write and report with DataFrames."""
