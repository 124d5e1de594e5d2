"""The same checks over arriving files."""
