"""Readers and writers: triples, property files, snapshots, and tables mapped to a graph."""
