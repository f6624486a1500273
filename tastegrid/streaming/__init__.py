"""Structured Streaming jobs on rating submissions."""
