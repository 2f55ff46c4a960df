"""Log tables on Spark: tagging, lossless encoding, template mining and scoring."""
