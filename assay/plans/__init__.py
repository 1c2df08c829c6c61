"""Whole checks made of operators."""
