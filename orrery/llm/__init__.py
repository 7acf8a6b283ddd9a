"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and the repository's entry module adds them when it can be imported.
"""
