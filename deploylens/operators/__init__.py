"""Operators over the relations: routes, detection, index."""
