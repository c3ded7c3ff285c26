"""Readers, writers and the account model over the warehouse tables."""
