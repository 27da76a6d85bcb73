"""Readers, writers and the file-level bookkeeping of a study."""
