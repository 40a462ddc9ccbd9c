"""Operators over axis frames, as DataFrame plans."""
