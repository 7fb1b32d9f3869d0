"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and ``__spark_entry__.py`` adds them when the subpackage is present.
"""
