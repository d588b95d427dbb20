"""Operators for preparing training text, vectors and archives at large scale.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` of
:mod:`lexstrata.llm.registry` list what it offers.
"""
