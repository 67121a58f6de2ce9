"""Named queries over the provided tables, grouped by operator family."""
