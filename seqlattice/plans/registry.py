"""Where queries and their SQL are registered, and SQL that several of them begin with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

TRIALS = 100

#: items, seq (all, by id), a and b (the two orderings).
SEQUENCES = """
items AS (SELECT vec_id + 1 AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
seq AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, v, label FROM items),
own AS (SELECT id FROM items ORDER BY id DESC LIMIT 4),
missing AS (SELECT id FROM items WHERE id NOT IN (SELECT id FROM own) ORDER BY md5('A:' || id) LIMIT 3),
a AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, v, label FROM items WHERE id NOT IN (SELECT id FROM own)),
b AS (SELECT row_number() OVER (ORDER BY md5('B:' || id)) - 1 AS pos, id, v, label, id IN (SELECT id FROM own) AS own FROM items WHERE id NOT IN (SELECT id FROM missing))"""


def registered(name: str, sql: str | None = None) -> Callable:
    def put(query: Callable) -> Callable:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def null_sql(observed: str, null: str, keys: list[str], extra: list[str] = []) -> str:
    """SELECT of keys, extra, mean, random_mean, random_sd, z_score, percentile for CTEs (keys, extra, mean) and (keys, mean)."""
    on = " AND ".join(f"o.{k} = s.{k}" for k in keys) or "true"
    cols = "".join(f"o.{c}, " for c in [*keys, *extra])
    return f"""
SELECT {cols}round(o.mean, 6) AS mean, round(avg(s.mean), 6) AS random_mean, round(stddev_pop(s.mean), 6) AS random_sd,
  round((o.mean - avg(s.mean)) / nullif(stddev_pop(s.mean), 0), 4) AS z_score, round(coalesce(sum(CASE WHEN s.mean <= o.mean THEN 1 ELSE 0 END) / nullif(count(s.mean), 0), 0), 6) AS percentile
FROM {observed} o LEFT JOIN {null} s ON {on} GROUP BY {cols}o.mean"""
