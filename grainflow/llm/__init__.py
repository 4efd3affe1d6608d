"""Operators for preparing large text and vector corpora for model training.

Nothing outside this folder imports it; each operator has a module of its own and
`queries.py` binds them to the standard tables.
"""
