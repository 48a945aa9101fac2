"""Clean and encode the string columns of large tables with Spark."""

from stringwright.plans.cleaner import StringCleaner, StringCleanerModel

__all__ = ["StringCleaner", "StringCleanerModel"]
