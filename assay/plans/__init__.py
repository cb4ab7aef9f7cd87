"""Whole runs, composed of the operators."""
