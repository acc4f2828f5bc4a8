"""Operators for building training data from raw text at scale.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``queries`` registers one query per operator.
"""
