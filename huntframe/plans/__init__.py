"""Query plans: the pipe language, SQL surface and the query catalogue."""
