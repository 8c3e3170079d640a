"""End-to-end reports, the registered queries and plan checks."""
