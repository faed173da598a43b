"""Operators for preparing training text: ten of them, each in a module of its own.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per operator.
"""
