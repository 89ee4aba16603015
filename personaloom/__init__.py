"""personaloom: Spark jobs that build, repair and analyse corpora about synthetic people.

Every operator takes and returns DataFrames (or Columns) and runs no action,
unless its docstring says so.
"""
