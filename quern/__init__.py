"""quern: a PySpark-native analytics engine for implicit-feedback data.

Everything is a function from DataFrames to a DataFrame. The subpackages:
``sources`` (readers, sinks), ``functions`` (column and vector functions),
``operators`` (joins, graphs, ranking, metrics, skew), ``plans`` (the named
queries with their SQL) and ``streaming``. ``llm`` holds operators for
training data; nothing else imports it.
"""
