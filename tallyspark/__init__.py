"""Ledger, reconciliation and audit analytics as DataFrame queries."""
