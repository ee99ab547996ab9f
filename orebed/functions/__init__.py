"""Column expressions: no I/O, no shuffles."""
