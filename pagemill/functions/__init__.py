"""Part of the core package."""
