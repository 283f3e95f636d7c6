"""reportloom: clinical report analytics as PySpark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Column names are keyword arguments, so the same operator runs on any
table with the right shape.
"""

__version__ = "0.1.0"
