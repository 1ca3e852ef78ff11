"""gradeloom: grading texts on an ordered label scale with Spark DataFrames."""
