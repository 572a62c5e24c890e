"""Registered queries: each operator applied to the driver's tables, with its SQL where SQL can express it."""
