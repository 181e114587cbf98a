"""Relational operators on points (id, vec) and edges (p, q, dist, is_new)."""
