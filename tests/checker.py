"""Run registered queries against their SQL on the same tables."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    rows = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    mine = normalise(spark_df.columns, rows)
    theirs = normalise(names, result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows / {len(theirs[1])}"
    bad = [k for k, v in kinds.items() if "HUGEINT" in v or "DECIMAL" in v]
    if bad:
        return f"SQL type of {bad}: {kinds}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{a} / {b}"
    for field in spark_df.schema.fields:
        want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(
            field.dataType.simpleString()
        )
        if want and want != kinds[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} / {kinds[field.name]}"
    return "" if rows else "no rows"


def main(folder: str, only: list[str]) -> None:
    from modelyard.plans.catalog import Tables, load_all
    from modelyard.session import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    for name, (function, sql) in load_all().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            df = function(Tables(spark, folder))
            if sql:
                problem = compare(df, con, sql)
            else:
                rows = df.collect()
                problem = f"rows only: {len(rows)}, {rows[0] if rows else None}"[:200]
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if not problem else 'rows' if problem.startswith('rows only') else 'BAD '} {name:34s} {time.time() - start:6.2f} {problem}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
