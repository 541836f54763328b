"""Run-log analytics as Spark DataFrame functions.

Every public function takes DataFrames or Columns and returns DataFrames or Columns; nothing
runs until the caller acts on the result, except where a docstring says so.
"""
