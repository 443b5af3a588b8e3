"""Newline-delimited JSON by table and window."""
