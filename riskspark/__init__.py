"""Supply-chain risk analytics on Spark DataFrames."""
