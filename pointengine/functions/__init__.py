"""Part of pointengine."""
