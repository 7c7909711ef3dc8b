"""Plans over stored tables."""
