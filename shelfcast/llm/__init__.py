"""Operators for training-data corpora: one module each, over tables of texts.

Nothing else in the library imports this subpackage.
"""
