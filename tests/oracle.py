"""Compare registered queries with their SQL on the driver tables (same check the tests use)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in r) for r in zip(*columns)]
    return names, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string when equal, else a short reason."""
    got = fn(spark, sf_dir).toArrow()
    want = con.sql(sql).to_arrow_table()
    gn, gr = _rows(got)
    wn, wr = _rows(want)
    if gn != wn:
        return f"columns {gn} != {wn}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} != {len(wr)}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return f"{len(bad)} of {len(gr)} rows differ {gn}: spark {bad[0][0]} sql {bad[0][1]}"
    types = {n: (got.schema.field(n).type, want.schema.field(n).type) for n in gn}
    loose = {n: f"{a}/{b}" for n, (a, b) in types.items() if str(a).replace("large_", "") != str(b) and "timestamp" not in str(a)}
    return f"OK {len(gr)} types {loose}" if loose else f"OK {len(gr)}"


def main(sf_dir: str, pick: list[str]) -> None:
    import __spark_entry__ as entry
    from priorline.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                verdict = f"rows-only {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = "ERROR " + str(e)[:900]
        print(f"{name:34s} {time.time() - start:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1], sys.argv[2:])
