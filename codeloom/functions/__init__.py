"""Small building blocks shared by the engine."""
