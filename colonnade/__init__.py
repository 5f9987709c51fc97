"""Columnar file analytics on Spark: ORC scans, projection, seek, statistics, footers and encodings."""
