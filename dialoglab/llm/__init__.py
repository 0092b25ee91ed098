"""Operators of a training-data pipeline (sharding, dedup, joins, scans, tokens, mixing).

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only when it can be imported.
"""
