"""Readers and writers: driver tables, CSV panels, prediction and runtime files."""
