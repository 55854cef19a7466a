"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``queries`` holds the thin digests of their outputs.
"""
