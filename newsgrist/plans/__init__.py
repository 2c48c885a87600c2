"""Composite jobs, and the views and queries over the test tables."""
