"""Batch drivers over the operators, and the ledger that makes reruns repeatable."""
