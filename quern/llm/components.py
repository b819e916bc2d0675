"""Connected components, as the engine's graph operators have them."""

from quern.operators.components import connected_components

__all__ = ["connected_components"]
