"""Readers, writers, snapshots, incremental sources and test-table bindings."""
