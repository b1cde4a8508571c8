"""tarn: text search, link analysis and corpus preparation on Spark DataFrames."""
