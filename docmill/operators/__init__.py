"""Relational operators over chunks, queries, turns and assets."""
