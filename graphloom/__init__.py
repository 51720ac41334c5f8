"""graphloom: set-oriented flow-graph analytics on PySpark DataFrames.

Every operator takes tables that hold *all* functions (``function_id`` is a partition key) and
returns a DataFrame; a one-function question is a filter on the key.
"""
