"""Check tables against data dictionaries and load the valid ones, on Spark."""

from tabwarden.model import Cde, ErrorClass, Profile

__all__ = ["Cde", "ErrorClass", "Profile"]
