"""Operators for preparing training text at corpus scale.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
