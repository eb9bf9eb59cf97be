"""Named queries on the driver tables and their independent SQL."""
