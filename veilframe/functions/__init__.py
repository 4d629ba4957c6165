"""Column builders: masks, noise and text checks. Everything here is a native expression."""
