"""Operators over documents, graphs, histories and events."""
