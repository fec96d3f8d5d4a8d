"""Document and knowledge analytics as plain Spark jobs.

Every public function takes DataFrames (or Columns) and returns a DataFrame
(or Column); nothing here runs an action unless its docstring says so.
"""
