"""Driver-table stand-ins, oracle SQL and the registered query catalogue."""
