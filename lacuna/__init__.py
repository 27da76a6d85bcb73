"""Missing-data analytics on Spark: harmonise, mask, impute, score, predict and rank."""
