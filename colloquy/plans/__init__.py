"""Registered queries: each composes operators over the tables and comes with its SQL."""
