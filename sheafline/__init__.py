"""Business analytics as DataFrame-in, DataFrame-out functions on Spark."""

from sheafline.errors import AnalyticsError

__all__ = ["AnalyticsError"]
