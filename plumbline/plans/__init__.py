"""Plan choices, statistics and decisions."""
