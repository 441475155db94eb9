"""Readers of sheet rows and writers of results."""
