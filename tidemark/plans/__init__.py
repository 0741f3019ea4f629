"""Queries: compositions of the operators, each beside the SQL that it is compared with."""
