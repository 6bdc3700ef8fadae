"""Readers: canonical tables from files of each kind."""
