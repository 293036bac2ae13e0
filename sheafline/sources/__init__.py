"""Reading and writing tables: CSV, JSON, binary documents, issue feeds, and the registry."""
