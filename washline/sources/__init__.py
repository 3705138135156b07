"""Sources (S-*) and sinks (K-*), plus the driver-table fixture views."""
