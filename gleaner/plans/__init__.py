"""Stored layouts and the multi-stage jobs that fill them."""
