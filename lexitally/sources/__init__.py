"""Feeds to read from and stores to read from and write to."""
