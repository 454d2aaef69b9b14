"""Readers, writers and driver-table fixtures."""
