"""Product analytics on Apache Spark: DataFrame in, DataFrame out."""
