"""Mixing sources to target weights by iterative proportional fitting (raking).

Token weights are counted by cell of source, language and topic; fitting scales the cells until
their sums along each dimension meet the targets; documents are then sampled with the
probabilities that follow, by a hash of their id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: Most occurring cells that are fitted on the driver; more are fitted by Spark aggregates.
MAX_CELLS = 200_000
OTHER = "(other)"
#: Rounds of fitting; each scales all dimensions once.
ROUNDS = 20


def fit_weights(cells: dict[tuple, float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Factor for each cell, so that the cells' scaled weights have the targets' shares along each dimension.

    Shares of categories without weight can't be met; the other shares of the dimension are then
    scaled to sum to 1. A category without a target keeps its share of what is left over. Cells
    without weight get factor 0.
    """
    keys = sorted(k for k, w in cells.items() if w > 0)
    if not keys:
        return dict.fromkeys(cells, 0.0)
    w = np.array([cells[k] for k in keys])
    w = w / w.sum()
    now = w.copy()
    dims = []
    for d, target in enumerate(targets):
        names, at = np.unique([k[d] for k in keys], return_inverse=True)
        own = np.bincount(at, w)
        share = np.array([target.get(n, np.nan) for n in names], float)
        free = np.isnan(share)
        left = max(0.0, 1 - np.nansum(share))
        if free.any():
            share[free] = left * own[free] / own[free].sum()
        dims.append((at, share / share.sum()))
    for _ in range(rounds):
        for at, share in dims:
            now = now * np.where((s := np.bincount(at, now)) > 0, share / np.where(s > 0, s, 1), 0)[at]
    return dict.fromkeys(cells, 0.0) | dict(zip(keys, (now / w).tolist()))


def fit_apart(cells: DataFrame, names: list[str], targets: list[dict[str, float]] | None, power: float, rounds: int = ROUNDS) -> DataFrame:
    """``fit_weights`` by aggregates: ``cells`` has ``names`` and ``tokens``, ``weight`` is added. Without targets the shares are ``tempered``."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.where("tokens > 0").withColumn("now", F.col("tokens") / F.lit(total or 1.0))
    shares = []
    for d, n in enumerate(names):
        own = now.groupBy(n).agg(F.sum("tokens").cast("double").alias("own"))
        if targets is None:
            own = own.withColumn("share", F.pow("own", F.lit(power)))
        else:
            given = spark.createDataFrame(sorted(targets[d].items()), f"{n} string, share double")
            own = materialize(own.join(given, n, "left"), "shares")
            met, free = own.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("own")))).first()
            own = own.withColumn("share", F.coalesce("share", F.lit(max(0.0, 1 - (met or 0.0))) * F.col("own") / F.lit(free or 1.0)))
        own = materialize(own.select(n, "share"), "shares")
        shares.append(own.withColumn("share", F.col("share") / F.lit(own.agg(F.sum("share")).first()[0] or 1.0)))
    for _ in range(rounds):
        for n, share in zip(names, shares):
            scale = now.groupBy(n).agg(F.sum("now").alias("s")).join(share, n).select(n, F.when(F.col("s") > 0, F.col("share") / F.col("s")).otherwise(0.0).alias("x"))
            now = materialize(now.join(scale, n).select(*names, "tokens", (F.col("now") * F.col("x")).alias("now")), "fit")
    fitted = now.select(*names, "tokens", (F.col("now") / (F.col("tokens") / F.lit(total or 1.0))).alias("weight"))
    return materialize(fitted.union(cells.where("NOT tokens > 0").select(*names, "tokens", F.lit(0.0))), "cells")


def tempered(counts: dict[str, float], power: float) -> dict[str, float]:
    """Targets from observed weights: shares of ``weight ** power``; a power under 1 lifts what is rare."""
    raised = {k: v**power for k, v in counts.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def token_count(text_col: str = "text") -> Column:
    """Words between white space; null has none."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def topic_of(text_col: str = "text") -> Column:
    """What kind of text a document is, from its whole text, for tables without topics.

    The first that holds: table (5 bars and more), questions (a third and more of the sentence marks are
    question or exclamation marks), brief (under 400 characters), prose. Null counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.length(text)

    def count(mark: str) -> Column:
        return size - F.length(F.replace(text, F.lit(mark), F.lit("")))

    asked = count("?") + count("!")
    return F.when(count("|") >= 5, "table").when((asked > 0) & (asked * 2 >= count(".")), "questions").when(size < 400, "brief").otherwise("prose")


def unit_hash(id_col: str, seed: str = "") -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of the MD5 of the id as text; null as the empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, dims: list[Column], targets: list[dict[str, float]] | None = None, tokens: Column | None = None, id_col: str = "doc_id", power: float = 0.7, budget: float | None = None, rounds: int = ROUNDS, name: str = "__mix") -> DataFrame:
    """All rows with ``tokens``, the categories, ``weight``, ``probability`` and ``sampled`` added in the struct ``name``.

    ``targets`` has a share for each category and dimension; None takes them from the observed
    weights of all categories by ``tempered(.., power)``. Categories without one of the given
    targets fall together under "(other)", and nulls always. Up to ``MAX_CELLS`` occurring cells
    are fitted on the driver, more by ``fit_apart``. Weights are the fitted factors; probabilities
    are proportional to them, with the largest at 1, or scaled down to ``budget`` expected tokens.
    Documents without tokens have their cell's probability; a cell without any tokens has weight 0.
    Repeated ids are sampled together; an empty table gives no rows. Columns of any name may be in
    ``docs``; one that is called ``name`` is replaced.
    """
    spark = docs.sparkSession
    tokens = token_count() if tokens is None else tokens
    names = [f"d{i}" for i in range(len(dims))]
    own = [c for c in docs.columns if c != name]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), tokens.alias("tokens"), unit_hash(f"`{id_col}`").alias("u"), *[F.coalesce(d.cast("string"), F.lit(OTHER)).alias(n) for d, n in zip(dims, names)])
    for n, t in zip(names, targets or []):
        keyed = keyed.withColumn(n, F.when(F.col(n).isin(*t), F.col(n)).otherwise(F.lit(OTHER)) if t else F.lit(OTHER))
    seen = materialize(keyed.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")  # the texts are read once for this
    if seen.count() <= MAX_CELLS:
        cells = {tuple(r[:-1]): float(r[-1]) for r in seen.collect()}
        if targets is None:
            targets = [tempered(_along(cells, d), power) for d in range(len(names))]
        factors = fit_weights(cells, targets, rounds)
        top, expected = max(factors.values(), default=0.0), sum(cells[k] * f for k, f in factors.items())
        table = spark.createDataFrame([(*k, float(f)) for k, f in sorted(factors.items())], ", ".join(f"{n} string" for n in names) + ", weight double")
        place = F.broadcast  # bounded by MAX_CELLS
    else:
        fitted = fit_apart(seen, names, targets, power, rounds)
        top, expected = fitted.agg(F.max("weight"), F.sum(F.col("tokens") * F.col("weight"))).first()
        table, place = fitted.select(*names, "weight"), lambda x: x
    scale = 1 / (top or 1.0)
    if budget is not None:
        scale *= min(1.0, budget / (expected * scale)) if expected else 1.0
    table = table.withColumn("probability", F.round(F.col("weight") * F.lit(scale), 6))
    found = keyed.join(place(table), names)
    extra = F.struct("tokens", *names, "weight", "probability", (F.col("u") < F.col("probability")).alias("sampled")).alias(name)
    return found.select(*[F.col(f"doc.`{c}`") for c in own], extra)


def _along(cells: dict[tuple, float], d: int) -> dict[str, float]:
    """Summed weights of the categories of a dimension."""
    out: dict[str, float] = {}
    for k, w in cells.items():
        out[k[d]] = out.get(k[d], 0.0) + w
    return out
