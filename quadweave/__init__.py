"""Graph-table analytics and corpus preparation on Spark DataFrames."""
