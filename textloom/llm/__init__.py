"""Operators of a training-data pipeline: ten operators, their queries and SQL.

Nothing outside this package imports it; ``__spark_entry__.py`` adds
``textloom.llm.queries`` only where the package is present.
"""
