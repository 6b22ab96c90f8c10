"""covey: affiliation-overlap analytics and training-data preparation on Spark DataFrames."""
