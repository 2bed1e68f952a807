"""Column functions, special functions and numeric kernels."""
