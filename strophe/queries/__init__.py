"""Registered queries: each binds an operator of the library to the driver's tables."""
