"""Operators of a large-scale training-data pipeline, each with its own module.

Nothing outside this subpackage imports it; ``catalog`` holds the registered queries.
"""
