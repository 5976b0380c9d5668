"""Live variants of the session operators."""
