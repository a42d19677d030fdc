"""Analyses: functions from DataFrames to DataFrames, and summaries that collect a bounded number of rows."""
