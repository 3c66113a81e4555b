"""Operators of a training-data pipeline (archives, dedup, mixing, packing, ...).

Nothing else in the library imports this subpackage; the queries on these
operators are registered in :mod:`ledgerline.llm.queries`.
"""
