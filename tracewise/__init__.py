"""Moving-object analytics and corpus preparation on Spark DataFrames."""
