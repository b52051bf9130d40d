"""Structured Streaming forms of duplicate removal, profiling and drift (an extension)."""
