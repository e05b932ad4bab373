"""Readers: search archive, catalogue dump, raw layer, demonstration traffic."""
