"""Analytics on Spark DataFrames: sources, operators, functions, plans and streams."""
