"""Operators of a large-scale training-text pipeline.

Nothing else in the library imports this subpackage; ``queries()`` and
``oracle_sql()`` of :mod:`arraysail.llm.registry` are added to the entry point
when it is there.
"""
