"""Folders that change."""
