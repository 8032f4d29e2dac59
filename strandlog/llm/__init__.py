"""Operators for large training-data pipelines.

Nothing outside this folder imports it: the rest of the library, its queries
and its tests work when the folder is removed.
"""
