"""Change tables: layout, appends, range scans and streams."""
