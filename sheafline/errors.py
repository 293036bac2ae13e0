"""The one exception type callers need to handle."""

from __future__ import annotations


class AnalyticsError(ValueError):
    """A refused request, with a machine-readable ``code`` and a readable message."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


def check_range(value: int, low: int, high: int, code: str, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise AnalyticsError(code, f"{what} must be an integer between {low} and {high}, got {value!r}.")
    return value
