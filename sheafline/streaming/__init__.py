"""The two operators that also run incrementally."""
