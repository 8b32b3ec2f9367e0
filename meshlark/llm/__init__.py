"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``registry`` has the queries and their SQL.
"""
