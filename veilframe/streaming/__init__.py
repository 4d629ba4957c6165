"""Private releases over streams."""
