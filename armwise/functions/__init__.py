"""Part of armwise; see the README."""
