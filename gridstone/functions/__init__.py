"""gridstone."""
