"""Operators for preparing language-model training data.

Nothing else in ``victual`` imports this package, and it imports nothing from
the rest of ``victual``; both can be used without the other.
"""
