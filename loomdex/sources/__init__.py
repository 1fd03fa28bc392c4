"""Readers: workspaces, tables and snapshots."""
