"""Lenient html trees, selectors and serialisation, for use inside Arrow functions."""
