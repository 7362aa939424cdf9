"""Time-driven state: leases and claims."""
