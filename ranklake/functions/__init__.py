"""Column functions and the plug-in surface for models."""
