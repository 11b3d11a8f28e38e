"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  ``trustloom.llm.catalog`` lists
the queries that apply each operator to its whole table.
"""
