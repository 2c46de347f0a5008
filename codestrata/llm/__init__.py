"""Operators that prepare training text.  Nothing outside of this subpackage imports it."""
