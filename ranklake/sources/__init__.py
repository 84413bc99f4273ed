"""Readers and writers, schemas, query sets and shared storage."""
