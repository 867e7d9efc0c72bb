"""The driver-side control plane."""
