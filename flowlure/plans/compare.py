"""Spark-vs-SQL comparison used by the tests and by hand (``python -m flowlure.plans.compare``)."""

from __future__ import annotations

import datetime as dt
import math
import sys

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _canon(v) -> str:
    if v is None:
        return "NULL"
    try:
        import pandas as pd

        if v is pd.NaT:
            return "NULL"
    except ImportError:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return _canon(v.item())
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().isoformat(sep=" ")
    return str(v)


def rows_of(columns, records) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    rows = sorted(tuple(_canon(r[i]) for i in order) for r in records)
    return cols, rows


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from flowlure.plans import catalog, files
    from flowlure.plans.oracle import ORACLE_SQL

    QUERIES = catalog.QUERIES | files.QUERIES
    con = con or duckdb_connection(sf_dir)
    sdf = QUERIES[name](spark, sf_dir)
    s_cols, s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = {"name": name, "spark_rows": len(s_rows), "spark_cols": s_cols}
    if name not in ORACLE_SQL:
        res["oracle"] = None
        return res
    rel = con.execute(ORACLE_SQL[name])
    d_cols_raw = [d[0] for d in rel.description]
    d_cols, d_rows = rows_of(d_cols_raw, rel.fetchall())
    res.update(oracle_rows=len(d_rows), oracle_cols=d_cols, cols_match=s_cols == d_cols,
               values_match=s_rows == d_rows)
    if not res["values_match"]:
        ss, dd = set(s_rows), set(d_rows)
        res["only_spark"] = sorted(ss - dd)[:5]
        res["only_oracle"] = sorted(dd - ss)[:5]
    return res


def main(argv=None) -> int:
    from flowlure.session import local_session

    argv = argv or sys.argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from flowlure.plans import catalog, files

    spark = local_session()
    con = duckdb_connection(sf_dir)
    bad = 0
    for name in names or [*catalog.QUERIES, *files.QUERIES]:
        r = compare(spark, sf_dir, name, con)
        ok = r.get("oracle") is None or (r["cols_match"] and r["values_match"])
        bad += not ok
        print(("OK  " if ok else "FAIL"), name, {k: v for k, v in r.items() if k not in ("name",) and (not ok or k.endswith("rows"))})
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
