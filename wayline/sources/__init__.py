"""Readers and writers. Every reader has an explicit schema and keeps malformed rows visible."""
