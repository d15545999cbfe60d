"""Operators of a training-data pipeline over tables of whole documents.

Nothing else in the library imports this subpackage. Each module holds one operator; :mod:`.queries`
binds the operators to the standard tables.
"""
