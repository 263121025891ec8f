"""Whole runs composed from the operators."""
