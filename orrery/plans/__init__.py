"""Registered queries: the library's operators over the test tables, each with the SQL it must agree with."""

from orrery.plans import assets, measures, queue, search, texts

QUERIES, ORACLE_SQL = {}, {}
for _part in (search, assets, queue, texts, measures):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
