"""logloom: analytics over tool-using conversation logs, written for Spark.

Everything takes DataFrames and gives DataFrames.  ``operators`` holds the
building blocks, ``functions`` column expressions, ``sources`` and ``sinks``
readers and writers, ``plans`` the named queries, ``streaming`` the incremental
variants.  The optional subpackage ``llm`` adds operators for training data;
nothing here imports it.
"""
