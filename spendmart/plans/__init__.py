"""Compositions of operators: the ingest job and the marts a dashboard card shows."""
