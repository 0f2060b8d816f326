"""Pipelines composed from the functions and operators."""
