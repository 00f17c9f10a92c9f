"""Risk scoring, flag statistics and model evaluation on Spark DataFrames."""
