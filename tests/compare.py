"""Compare registered queries with their SQL, as sets of rows.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def bag(rows) -> Counter:
    return Counter(tuple(_cell(v) for v in row) for row in rows)


def compare(df, db, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    got = bag(df.select(*names).collect())
    answer = db.sql(sql)
    if sorted(answer.columns) != names:
        return f"columns {names} != {sorted(answer.columns)}"
    want = bag(answer.select(*[f'"{n}"' for n in names]).fetchall())
    if got == want:
        return None
    only_got, only_want = list((got - want).items())[:2], list((want - got).items())[:2]
    return (
        f"{sum(got.values())} rows, {sum(want.values())} wanted; "
        f"{sum((got - want).values())} differ; got {str(only_got)[:600]} want {str(only_want)[:600]}"
    )


def main() -> None:
    import __spark_entry__ as entry
    from cuespark.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, db = local_session(8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, db, oracles[name]) if name in oracles else f"rows {df.count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        if problem and not problem.startswith("rows"):
            bad.append(name)
        print(f"{name}: {problem or 'equal'} ({time.time() - start:.1f}s)", flush=True)
    print("different:", bad, "without SQL:", sorted(set(queries) - set(oracles)),
          "SQL without query:", sorted(set(oracles) - set(queries)))


if __name__ == "__main__":
    main()
