"""Compare registered queries with their SQL checks: python tests/check_oracles.py [sf] [name...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def rows_of(table):
    columns = sorted(table.column_names)
    data = table.select(columns).to_pylist()
    return columns, [str(table.schema.field(c).type) for c in columns], sorted(
        tuple(canonical(r[c]) for c in columns) for r in data
    )


def compare(spark, connection, name, folder, query, sql):
    start = time.time()
    columns, types, rows = rows_of(query(spark, folder).toArrow())
    spent = time.time() - start
    if sql is None:
        return None, f"rows={len(rows)} (no check) {spent:.1f}s"
    start = time.time()
    other_columns, other_types, other = rows_of(connection.sql(sql).to_arrow_table())
    oracle_time = time.time() - start
    if columns != other_columns:
        return False, f"columns {columns} != {other_columns}"
    loose = [(c, a, b) for c, a, b in zip(columns, types, other_types) if a != b and not ("string" in a and "string" in b)]
    if loose:
        return False, f"types {loose}"
    if rows != other:
        mine, theirs = set(rows) - set(other), set(other) - set(rows)
        return False, f"rows {len(rows)}/{len(other)} only-spark {len(mine)} {sorted(mine)[:2]} only-sql {len(theirs)} {sorted(theirs)[:2]}"
    return True, f"rows={len(rows)} {spent:.1f}s (sql {oracle_time:.1f}s)"


def main():
    import duckdb
    from pyspark.sql import SparkSession

    from vozlake.plans import ORACLES, QUERIES

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    names = [n for n in QUERIES if not wanted or any(n.startswith(w.rstrip('*')) if w.endswith('*') else n == w for w in wanted)]
    for name in names:
        try:
            ok, message = compare(spark, connection, name, folder, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        if ok is False:
            bad.append(name)
        print(("none " if ok is None else "ok   " if ok else "FAIL ") + name + " " + message[:1500], flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")


if __name__ == "__main__":
    main()
