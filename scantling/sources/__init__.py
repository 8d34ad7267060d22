"""Readers, writers and the driver-table fixtures."""
