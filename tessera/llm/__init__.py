"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  ``queries`` holds the thin
registered queries; every other module is one operator with its general interface.
"""
