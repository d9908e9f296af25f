"""Readers: CSV, fixed-width text, syntax files, file discovery, model output."""
