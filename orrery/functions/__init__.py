"""Windows, column expressions and numeric kernels."""
