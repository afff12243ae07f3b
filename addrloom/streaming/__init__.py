"""Record streams."""
