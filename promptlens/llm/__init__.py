"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  ``queries`` registers
one query per operator; every operator module can also be used by itself.
"""
