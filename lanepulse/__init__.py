"""Road-occupancy analytics as DataFrame operators."""
