"""Column expressions; no jobs, no I/O."""
