"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one operator;
``queries`` registers them over the standard tables.
"""
