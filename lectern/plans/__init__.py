"""Compositions of operators: the lint plan and the registered queries."""
