"""Balance, compare and profile labelled prompt tables with Spark DataFrames."""
