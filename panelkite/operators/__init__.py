"""Operators over panels."""
