"""Operators for preparing training text from the papers of a knowledge base.

Nothing else in the library imports this subpackage; ``queries`` registers its operators.
"""
