"""surmise: symbolic Datalog over Spark DataFrames."""
