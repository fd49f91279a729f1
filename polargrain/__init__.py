"""polargrain: LiDAR log-polar mapping analytics expressed as Spark DataFrames."""
