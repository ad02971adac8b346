"""Readers and writers for vocabularies, coordinates and models."""
