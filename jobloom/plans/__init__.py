"""Registered queries, their stand-in inputs and their SQL checks."""
