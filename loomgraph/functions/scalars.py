"""Scalar column rules: first non-empty value, entity of an id, safe casts, edge weights, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.ids import WHITE

# Weight of an edge by its tier of evidence.
EVIDENCE_WEIGHT = {"experimental": 1.0, "curated": 0.75, "inferred": 0.5, "predicted": 0.25}
DEFAULT_WEIGHT = 0.5


def strip_cui(c: Column) -> Column:
    """Id without surrounding white space and one trailing CUI mark."""
    return F.regexp_replace(F.btrim(c, F.lit(WHITE)), r" CUI\z", "")


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def by_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first rule whose pattern matches at the start; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(c.rlike(f"^(?:{pattern})"), value).otherwise(out)
    return out


def safe_double(c: Column) -> Column:
    """Number in a text; null where there is none, for NaN and infinities too."""
    x = F.regexp_extract(F.trim(c), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z", 0).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes")


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    """Integer from 0 to 2^60 - 1 by md5 of the seed and the columns' texts: the same in any engine."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in parts))), 1, 15), 16, 10).cast("long")


def seeded_hash_sql(seed: int, *columns: str) -> str:
    return f"""('0x' || substr(md5('{seed}'{"".join(f" || '|' || {c}" for c in columns)}), 1, 15))::BIGINT"""


def edge_weight(confidence: Column, value: Column, evidence: Column) -> Column:
    """The first of confidence and value that is not blank, if it is a finite number; else the tier of evidence, else a default."""
    given = F.coalesce(F.nullif(F.trim(confidence), F.lit("")), F.nullif(F.trim(value), F.lit("")))
    tier = reduce(lambda w, kv: w.when(F.lower(F.trim(evidence)) == kv[0], kv[1]), EVIDENCE_WEIGHT.items(), F.when(F.lit(False), F.lit(None).cast("double")))
    return F.coalesce(safe_double(given), tier, F.lit(DEFAULT_WEIGHT))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted up so that it holds to 1e-12 from 0 on."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    product = reduce(lambda a, i: a * (n.cast("double") + float(i)), range(2, 9), n.cast("double") + 1.0)
    return series - F.log(product)


def hypergeometric_tail(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) for ``drawn`` of ``population`` items without replacement, ``marked`` of them being hits; 1 if k <= 0."""

    def choose(n: Column, r: Column) -> Column:
        return log_factorial(n) - log_factorial(r) - log_factorial(n - r)

    last = F.least(marked, drawn)
    first = F.greatest(k, marked + drawn - population, F.lit(0))
    base = choose(population, drawn)
    terms = F.aggregate(
        F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0),
        lambda acc, i: acc + F.exp(choose(marked, i) + choose(population - marked, drawn - i) - base),
    )
    return F.when(k <= 0, 1.0).otherwise(F.least(terms, F.lit(1.0)))
