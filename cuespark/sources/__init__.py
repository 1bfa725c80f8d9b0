"""Reading and writing tables, reports and embedding sets."""
