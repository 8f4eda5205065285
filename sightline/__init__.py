"""Evaluation of perception systems on time-indexed Spark DataFrames."""
