"""Registered queries over the driver tables, with their SQL."""

MODULES = ("captures", "rows", "experiments", "wire")
