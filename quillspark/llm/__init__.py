"""Operators for preparing training text at corpus scale.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` derives the registered queries from them.
"""
