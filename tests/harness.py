"""Run a registered query on Spark and its oracle on DuckDB and compare the rows."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
           "double": "float", "float": "float", "string": "str", "varchar": "str", "boolean": "bool"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int,)):
        return ("n", float(v)) if abs(v) < 2**53 else ("n", v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return ("nan",) if math.isnan(v) else ("n", v + 0.0)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    return ("s", str(v))


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return len(rows), None
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    dtypes = {d[0]: str(d[1]).lower() for d in rel.description}
    got = rel.fetchall()
    problems = []
    if sorted(names) != cols:
        return len(rows), [f"columns {cols} vs {sorted(names)}"]
    for c in cols:
        a, b = _FAMILY.get(types[c], types[c]), _FAMILY.get(dtypes[c], dtypes[c])
        if a != b or dtypes[c] == "hugeint":
            problems.append(f"type {c}: {types[c]} vs {dtypes[c]}")
    idx = [names.index(c) for c in cols]
    want = sorted([tuple(_norm(r[i]) for i in idx) for r in got], key=repr)
    rows.sort(key=repr)
    if len(rows) != len(want):
        problems.append(f"rows {len(rows)} vs {len(want)}")
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. cols={cols}\n      spark {bad[0][0]}\n      duck  {bad[0][1]}")
    return len(rows), problems


if __name__ == "__main__":
    import pathlib

    sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))
    import __spark_entry__ as entry
    from armparity.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            n, problems = compare(spark, con, sf, name, fn, oracles.get(name))
            word = "rows-only" if problems is None else ("ok" if not problems else "DIFF")
            if n == 0:
                word += " EMPTY"
        except Exception as exc:  # noqa: BLE001 - the report continues
            n, problems, word = -1, [str(exc)[:900]], "ERROR"
        failed += bool(problems)
        print(f"{word:10s} {name:34s} rows={n} {time.time() - start:.2f}s", flush=True)
        for p in problems or []:
            print("     ", p)
    print("failed:", failed)
