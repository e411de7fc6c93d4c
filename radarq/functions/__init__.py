"""Column functions: bytes, codes and times."""
