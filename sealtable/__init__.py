"""An integrity-aware table engine on PySpark."""
