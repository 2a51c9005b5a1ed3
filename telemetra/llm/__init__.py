"""Operators for preparing training text at scale, and the queries that apply them.

Nothing outside this package imports it; ``__spark_entry__`` registers its queries when it is there.
"""
