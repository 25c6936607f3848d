"""Registered queries over the supplied tables, each with its reference SQL where one exists."""
