"""Readers and writers: tables, adapter views, source trees, parsers, snapshots."""
