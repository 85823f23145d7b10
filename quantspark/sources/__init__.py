"""Reading and writing of bars and audit tables."""
