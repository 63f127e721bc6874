"""Reusable relational operators, each a DataFrame-to-DataFrame function."""
