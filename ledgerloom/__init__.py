"""Payment-ledger reconciliation as PySpark batch and streaming jobs."""
