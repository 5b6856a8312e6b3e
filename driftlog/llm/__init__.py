"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
thin ``opN_<name>`` queries that bind the operators to the test tables.
"""
