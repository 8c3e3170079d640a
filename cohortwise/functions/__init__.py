"""Rule tables and per-row Column expressions."""
