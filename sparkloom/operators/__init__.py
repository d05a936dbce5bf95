"""Operators that are compositions of DataFrame operations."""
