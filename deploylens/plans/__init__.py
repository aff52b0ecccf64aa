"""The whole analysis."""
