"""Article intake, dedup and scoring as Spark DataFrame operators.

Every public operator takes and returns DataFrames. Operator ids in docstrings
"""
