"""Column functions: stable ids, line splitting, headings, path maps."""
