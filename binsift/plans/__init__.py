"""Registered queries: engine operators applied to the tables of a directory, with the SQL that checks them."""
