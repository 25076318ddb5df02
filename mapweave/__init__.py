"""Map-feature analytics on Spark: ETL, spatial joins, road networks, imagery and traces."""
