"""Writers of tables, and of text that other programs read."""
