"""Operators over whole documents."""
