"""Long-panel analytics expressed as Spark DataFrame plans."""

from quantloom.operators.panel import Panel

__all__ = ["Panel"]
