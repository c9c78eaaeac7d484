"""quern: an embedded-SQL analytics engine expressed with Spark DataFrames."""
