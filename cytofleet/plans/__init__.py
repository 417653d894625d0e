"""Registered queries: each binds an operator to the driver tables, with a SQL twin where one exists."""
