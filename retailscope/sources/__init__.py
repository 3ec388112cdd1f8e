"""Readers and writers: CSV exports, documents, published tables, and the stand-in star schema."""
