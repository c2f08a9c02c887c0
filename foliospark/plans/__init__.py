"""Whole document pipelines put together from the operators."""
