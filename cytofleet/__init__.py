"""Fleet-scale single-cell image profiling on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` over tables that hold many
fields at once, keyed by ``field_id`` (and ``cell_id``).
"""
