"""Whole studies made of operators."""
