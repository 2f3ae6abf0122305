"""Incremental statistics over document streams."""
