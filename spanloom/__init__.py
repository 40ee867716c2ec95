"""Ranked, budget-packed span search over DataFrames of text."""
