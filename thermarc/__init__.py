"""Thermarc: condition-monitoring analytics on Spark DataFrames."""
