"""Declarative research: specifications, their compilation to one aggregate each, and lifecycles."""
