"""Batch operators over change rows; each is a lazy DataFrame transformation."""
