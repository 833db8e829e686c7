"""Load delimited files into clean tables with Spark, and report on them.

``sources``    CSV scans, folder listings, JDBC reads
``functions``  column expressions the rest is built from
``operators``  cleaning rules (DataFrame -> DataFrame) and the grouped-count report
``sinks``      full-refresh writers: Parquet, published views, JDBC
``plans``      which rule and table a file gets, and the load itself
"""
