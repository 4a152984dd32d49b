"""Readers and writers of files, reports and parser output."""
