"""The analysis over archives as they arrive."""
