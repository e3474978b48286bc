"""Readers and writers: raw messages, stage tables, documents, vectors, models, logs."""
