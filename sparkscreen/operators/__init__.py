"""Relational operators of the screen."""
