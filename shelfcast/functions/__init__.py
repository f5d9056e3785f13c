"""Column functions (Catalyst expressions) and the small per-series fitting helpers."""
