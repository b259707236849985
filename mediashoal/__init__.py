"""mediashoal: a PySpark-native analytics engine for media catalogs.

Every operator takes and returns lazily composed DataFrames; Python kernels run
only where bytes have to become features.
"""
