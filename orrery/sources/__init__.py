"""Readers of files beside the tables."""
