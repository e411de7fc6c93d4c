"""Recordings and live feeds, read and written."""
