"""Readers and writers: YAML catalogs, list files, crosswalk caches, spreadsheets, JSON."""
