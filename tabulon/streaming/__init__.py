"""Statements over tables that grow: the same plans on Structured Streaming sources."""
