"""Readers, adapters, validators and writers."""
