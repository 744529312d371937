"""Training-data operators: scans, classifiers, near-duplicate search, mixing.

Nothing outside this folder imports it.  Every operator is a function from
DataFrames to DataFrames; ``parley.llm.queries`` holds the thin registered queries.
"""
