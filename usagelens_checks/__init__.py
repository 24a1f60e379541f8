"""Ledger-shaped views of the driver's tables, their queries and their SQL twins."""
