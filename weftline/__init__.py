"""weftline: run-trace analytics and large-table data processing on Spark.

Every operator takes and returns DataFrames.  ``weftline.llm`` is optional:
nothing outside it imports it.
"""
