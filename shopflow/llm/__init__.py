"""Operators for preparing training text at scale.

Nothing outside this package imports it. Each operator module has a general
interface; ``queries.py`` derives the registered queries from them.
"""
