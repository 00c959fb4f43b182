"""Registry of queries: a function of (spark, sf_dir), the DuckDB SQL for the same rows, and the result's shape.

Shape: key columns are passed through (as text where marked with !, for dates), value columns are doubles rounded to a number of digits on both
sides (below 0: to single precision, for means of decimals, which can sit on a half), so that the last bits
of floating-point sums do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, "Query"] = {}

#: DuckDB text of the derived tables of tidemark.sources.tables; a query's SQL gets those that it names.
VIEWS = {
    "v1": """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, min_by(value, ts) AS open, max(value) AS high,
      min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY 1, 2""",
    "v2": """SELECT u.d AS date, u.p AS y, l.p AS x
      FROM (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS p FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u
      JOIN (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS p FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) l ON u.d = l.d""",
    "v3": """SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS symbol, avg(l_extendedprice / l_quantity) AS close
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "v4": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem",
    "v5": "SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1",
    "v6": """SELECT symbol, DATE '1995-01-01' + CAST(k * 30 AS INT) AS in_date,
      CASE WHEN k % 3 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(k * 30 + 1500 AS INT) END AS out_date
      FROM (SELECT p_brand AS symbol, row_number() OVER (ORDER BY p_brand) AS k FROM (SELECT DISTINCT p_brand FROM part) b) t""",
    "v7": "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
}


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    keys: list[str]
    values: list[str]
    digits: int

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.run(spark, sf_dir)
        if not self.keys and not self.values:
            return out
        keys = [F.col(k[:-1]).cast("string").alias(k[:-1]) if k.endswith("!") else F.col(k) for k in self.keys]
        if self.digits < 0:
            return out.select(*keys, *[F.col(v).cast("float").cast("double").alias(v) for v in self.values])
        return out.select(*keys, *[(F.round(F.col(v).cast("double"), self.digits) + 0.0).alias(v) for v in self.values])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        named = [v for v in VIEWS if re.search(rf"\b{v}\b", self.sql)]
        parts = [f"{v} AS ({VIEWS[v]})" for v in named]
        body = self.sql.strip()
        recursive = ""
        if m := re.match(r"(?is)with\s+(recursive\s+)?", body):
            recursive = m[1] or ""
            at = _main_select(body)
            parts.append(body[m.end() : at].rstrip())
            body = body[at:]
        keys = [f"CAST({k[:-1]} AS VARCHAR) AS {k[:-1]}" if k.endswith("!") else k for k in self.keys]
        if self.digits < 0:
            shown = [f"CAST(CAST({v} AS FLOAT) AS DOUBLE) AS {v}" for v in self.values]
        else:
            shown = [f"round(CAST({v} AS DOUBLE), {self.digits}) + 0.0 AS {v}" for v in self.values]
        columns = ", ".join([*keys, *shown]) or "*"
        head = f"WITH {recursive}{', '.join(parts)}\n" if parts else ""
        return f"{head}SELECT {columns} FROM ({body}) AS result"


def _main_select(sql: str) -> int:
    """Place of the main select of WITH ... SELECT: the first one outside parentheses."""
    depth = 0
    for m in re.finditer(r"\(|\)|\bselect\b", sql, re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif not depth:
            return m.start()
    raise ValueError("no main select")


def query(name: str, sql: str | None = None, keys: str = "", values: str = "", digits: int = 6) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = Query(name, run, sql, keys.split(), values.split(), digits)
        return run

    return add
