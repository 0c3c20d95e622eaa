"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; ``queries.py`` registers
its queries with the driver entry point when the folder is present.
"""
