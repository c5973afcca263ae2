"""Streaming variant of the stateless stages (validate, transform)."""
