"""Operators for preparing language-model training corpora.

Nothing else in ``gleaner`` imports this subpackage.
"""
