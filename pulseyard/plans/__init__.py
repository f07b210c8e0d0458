"""Composite queries and the queries registered with the driver."""
