"""Analytics and interval operators on DataFrames."""
