"""Operators for preparing language-model training data, run on Spark DataFrames.

Nothing else in the library imports this subpackage; `corpusloom.llm.entry`
lists its queries.
"""
