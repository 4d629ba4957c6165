"""DataFrame operators: differential privacy, local privacy, k-anonymity, obfuscation, statistics."""
