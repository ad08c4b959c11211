"""Nutrition, calorie-budget and body-weight analytics as Spark DataFrames."""
