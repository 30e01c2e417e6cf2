"""Readers that turn stored rasters, points and vectors into tables."""
