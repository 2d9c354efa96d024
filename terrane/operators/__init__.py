"""Operators that compose DataFrames: key access, sets, components, spatial search and joins."""
