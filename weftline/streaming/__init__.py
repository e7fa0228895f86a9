"""Operators that keep state between increments."""
