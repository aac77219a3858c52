"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Each module holds one operator with its own
general interface, and one thin ``query(spark, sf_dir)`` that derives the registered digest columns.
"""
