"""Schema-first readers and writers."""
