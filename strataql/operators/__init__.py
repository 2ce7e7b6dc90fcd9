"""Operators that aren't one SELECT: recursion, changes to tables, text and spatial search."""
