"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; `queries` applies
them to whole tables.  Nothing outside this subpackage imports it.
"""
