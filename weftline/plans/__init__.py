"""Runs of several steps."""
