"""Declared tables and fixed values."""
