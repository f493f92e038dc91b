"""larkspan: ranking, search, extraction and operations analytics on PySpark."""
