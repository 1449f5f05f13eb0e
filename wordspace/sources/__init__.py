"""Readers and writers: corpus lines, vocabulary text, model text."""
