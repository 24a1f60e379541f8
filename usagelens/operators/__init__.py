"""Row-to-ledger extraction, pricing, users, authentication and quotas."""
