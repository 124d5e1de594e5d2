"""Whole jobs put together from the operators: validate, load, catalog changes."""
