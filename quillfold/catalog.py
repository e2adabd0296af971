"""All queries of the library and the SQL each is compared with."""

from __future__ import annotations

from quillfold.plans import event_queries, log_queries, merge_queries, record_queries, replica_queries

MODULES = (record_queries, event_queries, log_queries, merge_queries, replica_queries)


def queries():
    out = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql():
    out = {}
    for module in MODULES:
        out |= module.ORACLE
    return out
