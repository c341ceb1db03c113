"""Relational operators over point events."""
