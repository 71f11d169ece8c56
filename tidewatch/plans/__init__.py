"""Whole event tables and dashboard queries built from the operators."""
