"""Operators for preparing large text corpora (training data).

Nothing else in the library imports this subpackage.
"""
