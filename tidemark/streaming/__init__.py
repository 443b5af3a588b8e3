"""The live poll loop, and streaming forms of the batch operators."""
