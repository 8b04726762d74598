"""Readers and writers: transcripts, wire batches, the stored event table."""
