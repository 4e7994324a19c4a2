"""Reading raw files and tables."""
