"""Column expressions: they take and return Columns and never shuffle."""
