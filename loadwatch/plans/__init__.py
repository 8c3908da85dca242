"""Compositions of the operators: validation, reading the state, escalation."""
