"""Compare a Spark result with DuckDB SQL over the same tables."""

import duckdb
import pyarrow as pa


def rows(table) -> list[str]:
    """Rows as text, columns by name, in sorted order; of an Arrow table or a (names, rows) pair."""
    names, data = table if isinstance(table, tuple) else (table.column_names, list(zip(*[table[n].to_pylist() for n in table.column_names], strict=True)))
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


def duck(sql: str, **tables: pa.Table) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()
