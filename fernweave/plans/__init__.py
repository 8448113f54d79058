"""The queries of the engine and their SQL."""
