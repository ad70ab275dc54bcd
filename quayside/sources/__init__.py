"""Decoders of provider payloads."""
