"""Bindings of the domain to given tables, and whole queries over them."""
