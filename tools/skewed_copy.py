"""Write a copy of a data folder in which one key, total or text holds a third of all rows (developer tool)."""

from __future__ import annotations

import sys

import duckdb

CHANGES = {
    # lines that move to one order are numbered anew, as on a printed invoice
    "lineitem": "SELECT * REPLACE (CASE WHEN hot THEN 5 ELSE l_orderkey END AS l_orderkey, CASE WHEN hot THEN row_number() OVER (PARTITION BY hot) ELSE l_linenumber END AS l_linenumber)"
    " EXCLUDE (hot) FROM (SELECT *, l_orderkey = 5 OR hash(l_partkey, l_suppkey, l_linenumber, l_quantity) % 3 = 0 AS hot FROM t)",
    "orders": "SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey,"
    " CASE WHEN hash(o_orderkey, 1) % 3 = 0 THEN 1000.5 ELSE o_totalprice END AS o_totalprice) FROM t",
    "events": "SELECT * REPLACE (CASE WHEN hash(event_id) % 3 = 0 THEN 3 ELSE user_id END AS user_id) FROM t",
    "documents": "SELECT * REPLACE (CASE WHEN hash(doc_id) % 3 = 0 THEN (SELECT text FROM t WHERE length(text) > 2000 LIMIT 1) ELSE text END AS text) FROM t",
}


def main(source: str, target: str) -> None:
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{source}/{name}.parquet'")
        con.execute(f"COPY ({CHANGES.get(name, 'SELECT * FROM t')}) TO '{target}/{name}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    main(*sys.argv[1:3])
