"""Commerce-operations analytics on Spark: DataFrame in, DataFrame out."""
