"""Column functions: each takes and returns columns, all of them Catalyst expressions."""
