"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Each operator module has a
general interface; ``queries.py`` derives the fixed digest columns from it.
"""
