"""Run a registered query and its SQL on the same tables and compare rows and types."""

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else (f"{v:.9e}" if isinstance(v, float) else str(v))) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    mine = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} / {sorted(relation.columns)}"
    theirs_types = dict(zip(relation.columns, [str(t) for t in relation.types], strict=True))
    wrong = {c: (types[c], theirs_types[c]) for c in columns if DUCK_TYPES.get(types[c], types[c]) != theirs_types[c]}
    if wrong:
        return f"types {wrong}"
    theirs = sorted(relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=_key)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    exact = sum(a != b for a, b in zip(mine, theirs, strict=True))
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(_same(x, y) for x, y in zip(a, b, strict=True))]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"
    return f"only rounding: {exact} of {len(mine)} rows" if exact else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as registry
    from claimsift.session import build_session

    directory, wanted = sys.argv[1], sys.argv[2:]
    session = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="claimsift-compare-")})
    session.sparkContext.setLogLevel("ERROR")
    duck, oracles = connect(directory), registry.oracle_sql()
    for key, fn in registry.queries().items():
        if wanted and key not in wanted:
            continue
        begin = time.time()
        try:
            if key in oracles:
                outcome = compare(session, duck, key, fn, oracles[key], directory) or "ok"
            else:
                outcome = f"no sql, {len(fn(session, directory).collect())} rows"
        except Exception as error:
            outcome = f"FAILED {type(error).__name__}: {str(error)[:700]}"
        print(f"{key:32s} {time.time() - begin:7.2f}s  {outcome}", flush=True)
