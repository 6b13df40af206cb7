"""Operators over tables of media files."""
