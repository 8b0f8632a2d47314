"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` binds the
operators to the driver's tables.  Nothing outside this subpackage imports it.
"""
