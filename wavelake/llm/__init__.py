"""Operators for building large text training sets.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers the thin contract queries over them.
"""
