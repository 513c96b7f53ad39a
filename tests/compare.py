"""Compare registered queries with their SQL in DuckDB: ``python tests/compare.py [sf] [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from entrylake.plans import catalog  # noqa: E402
from entrylake.plans.inputs import TABLES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    return str(value)


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
          "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def difference(spark, con, sf_dir, name):
    """None if equal, else a short description; queries without SQL only have to run."""
    df = catalog.run(spark, sf_dir, name)
    got_names = sorted(df.columns)
    rows = df.select(*got_names).collect()
    got = sorted("|".join(_cell(v) for v in r) for r in rows)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != got_names:
        return f"columns {got_names} != {sorted(names)}"
    want_types = {c[0]: _TYPES.get(str(c[1]), str(c[1])) for c in cur.description}
    if want_types != dict(df.dtypes):
        return f"types {dict(df.dtypes)} != {want_types}"
    pick = [names.index(c) for c in got_names]
    want = sorted("|".join(_cell(r[i]) for i in pick) for r in cur.fetchall())
    if got == want:
        return None if got else "no rows"
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return (f"{len(got)} rows, want {len(want)}; spark only {[x[:160] for x in extra[:3]]}, "
            f"sql only {[x[:160] for x in missing[:3]]}")


if __name__ == "__main__":
    from entrylake.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    session = build_session("compare", cores="8", shuffle_partitions=8, spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(sf)
    for query in sys.argv[2:] or catalog.queries():
        began = time.time()
        try:
            problem = difference(session, duck, sf, query)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        checked = "sql" if query in catalog.oracle_sql() else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {checked:4} {time.time() - began:6.1f}s {query} {problem or ''}",
              flush=True)
