"""The fixed projection over the driver tables, and the registered queries."""
