"""Readers of run trees, logs, documents, queues, meshes and tracks, and the writers."""
