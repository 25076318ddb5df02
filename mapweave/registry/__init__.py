"""Registered queries over the driver tables, each beside the SQL it must equal."""
