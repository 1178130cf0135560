"""Operators for building language-model training data on Spark.

Nothing outside this subpackage imports it; its queries are listed in
``tessera.llm.queries`` and picked up by ``__spark_entry__`` when present.
"""
