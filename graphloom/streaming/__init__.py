"""Streams. The only one in scope is the spend ledger, an append-only folder of JSON lines."""
