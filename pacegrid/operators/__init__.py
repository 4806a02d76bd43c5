"""Relational operators over event rows."""
