"""What a plan's nodes do to DataFrames."""
