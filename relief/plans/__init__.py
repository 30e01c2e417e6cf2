"""Composed analyses and the views they run on."""
