"""Readers, connectors and sinks. Nothing here opens the network: files come from where they were fetched to."""
