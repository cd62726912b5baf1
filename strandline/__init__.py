"""strandline: versioned-wiki analytics and publication on Spark DataFrames."""
