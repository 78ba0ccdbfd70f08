"""Schemas of the file formats."""

KEY_VALUE = "key binary, value binary"
SERIALIZED = "data binary"
