"""Joins, bars and levels as DataFrame transformations."""
