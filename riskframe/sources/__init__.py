"""Sources, sinks and the driver-table adapters."""
