"""Legal-text entity analytics and corpus preparation on Spark DataFrames."""
