"""Column kernels and small numeric helpers."""
