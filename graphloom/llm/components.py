"""Connected components (``graphloom.operators.components``)."""

from graphloom.operators.components import components

__all__ = ["components"]
