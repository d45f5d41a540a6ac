"""Readers and writers of design files, logs and packages."""
