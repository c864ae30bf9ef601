"""Readers and writers: JSONL files, training sets."""
