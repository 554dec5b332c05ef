"""Declarative query specs: a dict becomes DataFrame operations; no SQL text is made."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, DEFAULT_ROWS = 1000, 50
UNITS = ("year", "month", "week", "day")
LEAVES = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "ilike": lambda c, v: c.ilike(v),
    "not_ilike": lambda c, v: ~c.ilike(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "contains": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v if isinstance(v, list) else [v])), c)) == 0,
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def _distinct_array(c: Column) -> Column:
    """Distinct values in order; a null among them is kept, at the end."""
    some = F.array_sort(F.collect_set(c))
    return F.when(F.count_if(c.isNull()) > 0, F.concat(some, F.array(F.lit(None)))).otherwise(some)


AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)) if c is None else F.count(c),
    "count_distinct": lambda c: F.countDistinct(c),
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "array_agg_distinct": _distinct_array,
}


def condition(tree: dict, resolve) -> Column:
    """A Column of a condition: {"and"|"or": [...]}, {"not": ...}, {"field", "op", "value"} or {"field", op: value}."""
    for word, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in tree:
            if not tree[word]:
                raise ValueError(f"empty {word}")
            return reduce(join, (condition(t, resolve) for t in tree[word]))
    if "not" in tree:
        return ~condition(tree["not"], resolve)
    if "field" not in tree:
        raise ValueError(f"no field in {tree}")
    ops = [(tree["op"], tree.get("value"))] if "op" in tree else [(k, v) for k, v in tree.items() if k != "field"]
    if not ops or any(op not in LEAVES for op, _ in ops):
        raise ValueError(f"unknown operator in {tree}")
    return reduce(lambda a, b: a & b, (LEAVES[op](resolve(tree["field"]), v) for op, v in ops))


def _alias(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"bad alias {name!r}")
    return name


def query(view: DataFrame, spec: dict[str, Any], allowed: set[str] | None = None) -> DataFrame:
    """Runs a spec on a view: where, then select with group_by and having, order_by, limit (at most 1000 rows) and offset."""
    names = allowed or set(view.columns)

    def field(name: str) -> Column:
        if name not in names:
            raise ValueError(f"unknown field {name!r}")
        return F.col(name)

    rows = view.filter(condition(spec["where"], field)) if spec.get("where") else view
    plain: list[tuple[str, Column]] = []
    made: list[tuple[str, Column]] = []
    grouped = bool(spec.get("group_by")) or any(k in AGGREGATES for s in spec.get("select", []) for k in s if isinstance(s, dict))
    for s in spec.get("select") or []:
        if isinstance(s, str):
            s = {"field": s}
        agg = next((k for k in s if k in AGGREGATES), None)
        if agg:
            made.append((_alias(s.get("as", agg)), AGGREGATES[agg](None if s[agg] == "*" else field(s[agg]))))
        elif "date_trunc" in s:
            if s["date_trunc"] not in UNITS:
                raise ValueError(f"date_trunc unit must be one of {UNITS}")
            plain.append((_alias(s["as"]), F.date_trunc(s["date_trunc"], field(s["field"]))))
        else:
            if grouped and s["field"] in ("body_text", "body_html"):
                raise ValueError("bodies cannot be grouped")
            plain.append((_alias(s.get("as", s["field"])), field(s["field"])))
    order = [(o["field"], o.get("dir", "asc").lower()) if isinstance(o, dict) else (o, "asc") for o in spec.get("order_by") or []]
    if not order and not grouped and "date" in view.columns:
        order = [("date", "desc")]
    hidden: list[str] = []
    if not grouped:
        if plain:
            hidden = [n for n, _ in order if n not in dict(plain) and n in names]
            out = rows.select(*(c.alias(n) for n, c in plain), *(F.col(n) for n in hidden))
        else:
            heavy = {"body_text", "body_html", "embedding"}
            out = rows.select(*(c for c in rows.columns if c not in heavy), *([F.left(F.col("body_text"), F.lit(500)).alias("body_preview")] if "body_text" in names else []))
    else:
        keys = [(g, dict(plain)[g] if g in dict(plain) else field(g)) for g in spec.get("group_by") or []]
        total = rows.groupBy(*(c.alias(n) for n, c in keys)).agg(*(c.alias(n) for n, c in made))
        known = {n for n, _ in [*keys, *made]}

        def result(name: str) -> Column:
            if name not in known:
                raise ValueError(f"unknown field {name!r}")
            return F.col(name)

        out = total.filter(condition(spec["having"], result)) if spec.get("having") else total
        shown = [n for n, _ in plain if n in known] + [n for n, _ in made]
        out = out.select(*(shown or sorted(known)))
    for n, _ in order:
        if n not in out.columns:
            raise ValueError(f"cannot order by {n!r}")
    out = out.orderBy(*(F.col(n).desc_nulls_first() if d == "desc" else F.col(n).asc_nulls_last() for n, d in order)) if order else out
    return out.offset(int(spec.get("offset", 0))).limit(min(int(spec.get("limit", DEFAULT_ROWS)), MAX_ROWS)).drop(*hidden)
