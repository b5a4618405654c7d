"""linkloom: requirement-to-code traceability and training-data processing on Spark DataFrames."""
