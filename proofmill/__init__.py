"""Evaluation analytics on Spark DataFrames.

Tables of prompts, answers and check results in; scores, outcomes, listings
and statistical verdicts out. Every operator takes DataFrames and returns
DataFrames; nothing is collected on the way.
"""
