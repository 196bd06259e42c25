"""Goal-based rubric modelling on Spark DataFrames."""
