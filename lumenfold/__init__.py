"""Photo-library analytics on Spark: DataFrame in, DataFrame out."""
