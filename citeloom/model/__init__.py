"""Model of the engine."""
