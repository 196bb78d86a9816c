"""Continuous record entry and safety surveillance."""
