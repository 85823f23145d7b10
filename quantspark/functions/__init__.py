"""Rules as Column expressions."""
