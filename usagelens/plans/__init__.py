"""Report plans over the ledger: filters, cube, grouped reports, reshaping."""
