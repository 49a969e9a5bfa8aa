"""tidegrid: gridded fishing effort, overlap risk and management what-ifs on PySpark.

Every public function takes and returns DataFrames or Columns, names its
columns by parameter and runs no job unless it is a contract check.
"""
