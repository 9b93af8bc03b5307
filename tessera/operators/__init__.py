"""Retrieval operators and versioned tables, as DataFrame programs."""
