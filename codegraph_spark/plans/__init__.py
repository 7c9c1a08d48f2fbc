"""Composite jobs: chains of the operators."""
