"""Parsers of untrusted bytes, with the standard library only. Each takes bytes and returns plain data; broken input gives None, never an error."""
