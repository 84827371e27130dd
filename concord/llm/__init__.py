"""Operators for large training-data pipelines, each a Spark job of its own.

Nothing else in the library imports this subpackage; its queries are listed in
``concord.llm.queries``.
"""
