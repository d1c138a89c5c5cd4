"""Operators for preparing large text corpora as training data.

Nothing outside this package imports it. Every operator is a function from
DataFrames to a DataFrame; ``mizan.llm.queries`` registers the thin queries that
apply them to whole tables.
"""
