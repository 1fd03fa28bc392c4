"""Composed queries and the engine facade."""
