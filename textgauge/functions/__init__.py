"""Text functions: normalization, spelled numbers, tokenization."""
