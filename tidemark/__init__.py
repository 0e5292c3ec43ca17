"""Approximate analytics over keyed data and time series, built from Spark DataFrames."""
