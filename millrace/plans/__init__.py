"""Chains of operators: step lists, stock cleaning plans, Bronze to Silver."""
