"""Point-in-time forecast histories and paired-policy analytics on Spark.

Every public function takes and returns DataFrames (or Columns); nothing is
executed until the caller runs an action, except where a docstring says so.
"""

__version__ = "0.1.0"
