"""Readers, views, sinks and session settings."""
