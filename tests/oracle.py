"""Compare registered queries with their SQL twins. Usage: python tests/oracle.py SF_DIR [name-prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "INTEGER": "int"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when rows, names and types agree, else what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} vs {sorted(rel.columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_types = {n: TYPES.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    if spark_types != duck_types:
        return f"types {spark_types} vs {duck_types}"
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted(
        list(zip(*df.select(*names).toArrow().to_pydict().values())), key=key,
    )
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall(), key=key)
    if got == want:
        return None
    gs, ws = set(got), set(want)
    return f"rows {len(got)} vs {len(want)}; only spark {list(gs - ws)[:2]}; only sql {list(ws - gs)[:2]}"


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as e
    from doclake.session import local_session

    spark = local_session("oracle", 8)
    con = connect(sf_dir)
    sqls, bad = e.oracle_sql(), 0
    for name, query in e.queries().items():
        if prefixes and not any(name == p or name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                note = "ok" if diff is None else f"DIFF {diff[:1500]}"
            else:
                diff, note = None, f"rows only: {df.count()}"
        except Exception as ex:  # report and go on with the other queries
            diff, note = ex, f"ERROR {str(ex)[:1500]}"
        bad += diff is not None
        print(f"{name:28s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
