"""Operators for preparing language-model training data. Nothing else in siftline imports this subpackage."""
