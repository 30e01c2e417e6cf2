"""Continuous intake of scenes."""
