"""Readers and writers of the ledger, the user dimension and price books."""
