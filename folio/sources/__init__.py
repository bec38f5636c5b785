"""Readers and writers of document containers."""
