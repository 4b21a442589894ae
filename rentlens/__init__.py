"""Screening analytics for short-term rentals on Spark DataFrames."""
