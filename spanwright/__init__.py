"""Discourse and reading-time analytics as Spark plans."""
