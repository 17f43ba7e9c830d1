"""Registered queries: each operator applied to the test tables, with SQL that gives the same rows."""
