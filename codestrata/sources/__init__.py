"""Readers of exported repository data and writers of results."""
