"""Queries by name, each with an independent SQL statement where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offermatch.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LISTINGS = f"listings AS ({bridge.LISTINGS_SQL})"
CATALOG = f"""catalog AS (
SELECT row_number() OVER (ORDER BY item_name) AS ord, * FROM ({bridge.CATALOG_SQL}))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def lcs_sql(a: str, b: str) -> str:
    """Bit-parallel LCS length of two SQL string expressions; the first has at most 62 letters."""
    mask = (
        f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN "
        f"substring({a}, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT"
    )
    full = f"((1::BIGINT << length({a})) - 1)"
    fold = (
        f"list_reduce(list_transform(string_split({b}, ''), lambda c: {mask}), "
        f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    )
    return (
        f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
        f"ELSE length({a}) - bit_count({fold}) END"
    )


def words_sql(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def token_set_ctes(source: str, a: str, b: str, keys: str) -> str:
    """CTEs that end in ``scored(keys, ts)``: the token-set ratio of two columns of a table."""
    return f"""
sets AS (SELECT {keys}, list_distinct({words_sql(a)}) AS wa, list_distinct({words_sql(b)}) AS wb
 FROM {source}),
parts AS (SELECT *, list_filter(wa, lambda w: list_contains(wb, w)) AS s,
 list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))) AS x,
 list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))) AS y FROM sets),
joined AS (SELECT *, length(array_to_string(s, ' ')) AS sl, array_to_string(x, ' ') AS xs,
 array_to_string(y, ' ') AS ys FROM parts),
lengths AS (SELECT *, CASE WHEN sl > 0 THEN 1 ELSE 0 END AS gap,
 CASE WHEN len(s) > 0 AND (len(x) = 0 OR len(y) = 0) THEN 0
  WHEN length(xs) <= length(ys) THEN {lcs_sql('xs', 'ys')} ELSE {lcs_sql('ys', 'xs')} END AS lcs
 FROM joined),
scored AS (SELECT {keys}, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE
 WHEN len(s) > 0 AND (len(x) = 0 OR len(y) = 0) THEN 100.0::DOUBLE
 WHEN sl = 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (length(xs) + length(ys) - 2 * lcs)
  / (length(xs) + length(ys))
 ELSE greatest(
  100.0::DOUBLE - 100.0::DOUBLE * (length(xs) + length(ys) - 2 * lcs)
   / (sl + gap + length(xs) + sl + gap + length(ys)),
  100.0::DOUBLE - 100.0::DOUBLE * (gap + length(xs)) / (sl + sl + gap + length(xs)),
  100.0::DOUBLE - 100.0::DOUBLE * (gap + length(ys)) / (sl + sl + gap + length(ys))) END AS ts
 FROM lengths)"""


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def tokens_sql(text: str) -> str:
    return TOKENS.format(text)
