"""Operators for preparing text corpora for model training; nothing else in the package uses them."""
