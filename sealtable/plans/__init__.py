"""Registered queries over the driver's tables, built from the engine's operators."""
