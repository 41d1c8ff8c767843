"""Plans of the analytics engine."""
