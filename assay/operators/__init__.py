"""Operators on DataFrames: conditions, folds, budgets, graphs, references, rules and links."""
