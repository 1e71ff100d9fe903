"""Operators for preparing large training corpora, each a DataFrame → DataFrame function over whole tables."""
