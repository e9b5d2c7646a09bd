"""Mixing to target weights: iterative proportional fitting of token weights, then Poisson sampling.

Documents fall into cells of AXES (source, language, topic). Raking scales the
cells' tokens until every marginal has its target share. A document's
probability is its cell's calibrated ratio times one scale, at most 1, such that
the expected tokens are the budget; it stays if a hash of its id and text falls
below.

Targets are shares by axis and value, as a caller states them. Values that the
table lacks, or with a share of 0, get nothing, and the rest is scaled to 1; an
axis without targets moves from its own shares towards equal ones by POWERS.

The table of cells is made by a partial aggregate, so hot sources cost each
task one row a cell. Up to LOCAL_CELLS cells are raked on the driver; beyond
that the same steps run as DataFrames in the shared folder. Targets that
contradict each other cannot all be met: after ROUNDS the last state is taken
and a warning names the largest deviation.

Defined cases: null source, language and text are values of their own ("",
"" and the empty text, topic ``empty``). Tokens are words; documents without one
weigh one token. An empty table gives no row. Repeated rows (id and text) share
one decision, as ties of the draw do; texts of any length are read whole.
Documents travel as one struct, so their columns may have any name.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest, stored

AXES = ("source", "lang", "topic")
#: How far the marginal of an axis without targets moves from its own shares (1) to equal shares (0).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET_SHARE = 0.6  # of the tokens
ROUNDS, CLOSE = 200, 1e-9
LOCAL_CELLS = 1_000_000
BROADCAST_CELLS = 100_000  # some 10 MB
SEED = 20240501
WORD = r"[^\x20\x09-\x0D]+"


def topic(words, text):
    """Kind of text, where the caller has no topic: empty, table, brief, article or long."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(words == 0, "empty").when(bars >= 8, "table").when(words < 100, "brief").when(words < 1000, "article").otherwise("long")


def with_cells(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """doc (all columns of ``docs`` as one struct), tokens (words, at least 1), and the cell: source, lang, topic.

    ``topic_of`` gives the topic from the columns of ``docs``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in AXES[:2]], (F.lit(None) if topic_of is None else topic_of).cast("string").alias("given"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    kind = F.coalesce("given", topic(F.col("words"), text)) if topic_of is None else F.coalesce("given", F.lit(""))
    return plain.select("doc", "source", "lang", kind.alias("topic"), F.greatest("words", F.lit(1)).cast("bigint").alias("tokens"))


def goals(axis: str, values: list[str], shares: np.ndarray, targets: dict | None) -> np.ndarray:
    """Target share of each value of an axis."""
    stated = (targets or {}).get(axis)
    out = np.array([float(stated.get(v, 0.0)) for v in values]) if stated else shares ** POWERS[axis]
    if out.min(initial=0) < 0 or not out.sum() > 0:
        raise ValueError(f"targets of {axis} must be shares of its values, and not all 0")
    return out / out.sum()


def _settled(worst: float) -> None:
    if worst >= 1e-6:
        warnings.warn(f"raking ended {worst:.3g} away from a target share", stacklevel=3)


def rake_local(keys: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Raked tokens of each cell, and how far the last round still moved. ``keys`` has each axis as codes; ``targets`` a share for each code."""
    x = tokens.astype(float)
    total, worst = x.sum(), 0.0
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(keys, targets, strict=True):
            have = np.bincount(code, x, len(target))
            ratio = np.divide(target * total, have, out=np.ones_like(have), where=have > 0)
            worst = max(worst, float(np.abs(ratio - 1)[target > 0].max()), float(have[target == 0].max(initial=0) / total))
            x *= ratio[code]
        if worst < CLOSE:
            break
    return x, worst


def scale_for(ratio: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The scale s at which sum(min(1, s * ratio) * tokens) is the budget; all that has a weight if the budget is beyond that."""
    some = ratio > 0
    order = np.argsort(-ratio[some], kind="stable")
    ratio, tokens = ratio[some][order], tokens[some][order]
    if not len(ratio):
        return 0.0
    # with the k highest ratios at probability 1, the rest shares what is left of the budget
    full = np.concatenate(([0.0], np.cumsum(tokens)[:-1]))
    scale = (budget - full) / np.cumsum((ratio * tokens)[::-1])[::-1]
    fits = np.flatnonzero(scale * ratio <= 1)
    return float(scale[fits[0]]) if len(fits) else 1.0 / ratio[-1]


def _probabilities_local(spark, cells: DataFrame, targets: dict | None, budget: float) -> DataFrame:
    got = cells.toPandas().sort_values(list(AXES)).reset_index(drop=True)
    tokens = got["tokens"].to_numpy(float)
    keys, wanted = [], []
    for axis in AXES:
        codes, values = got[axis].factorize(sort=True)
        keys.append(codes)
        wanted.append(goals(axis, list(values), np.bincount(codes, tokens, len(values)) / tokens.sum(), targets))
    raked, worst = rake_local(keys, tokens, wanted)
    _settled(worst)
    ratio = raked / tokens
    got["weight"] = ratio
    got["probability"] = np.minimum(1.0, scale_for(ratio, tokens, budget * tokens.sum()) * ratio)
    return spark.createDataFrame(got[[*AXES, "weight", "probability"]])


def _probabilities_spread(cells: DataFrame, targets: dict | None, budget: float) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    wanted = []
    for axis in AXES:
        have = cells.groupBy(axis).agg(F.sum("tokens").alias("t"))
        stated = (targets or {}).get(axis)
        if stated:
            table = F.create_map(*[F.lit(v) for k, x in stated.items() for v in (k, float(x))])
            share = F.coalesce(F.try_element_at(table, F.col(axis)), F.lit(0.0))
        else:
            share = F.pow(F.col("t") / total, POWERS[axis])
        have = have.withColumn("g", share)
        norm = have.agg(F.sum("g")).first()[0]
        if not norm > 0:
            raise ValueError(f"targets of {axis} must be shares of its values, and not all 0")
        wanted.append(stored(have.select(axis, (F.col("g") / norm * total).alias("goal")), "goal"))
    now, worst = cells.withColumn("x", F.col("tokens").cast("double")), 0.0
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, goal in zip(AXES, wanted, strict=True):
            have = now.groupBy(axis).agg(F.sum("x").alias("have")).join(goal, axis)
            factor = stored(have.select(axis, "goal", "have", F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(F.lit(1.0)).alias("f")), "factor")
            off = F.when(F.col("goal") > 0, F.abs(F.col("f") - 1)).otherwise(F.col("have") / total)
            worst = max(worst, factor.agg(F.max(off)).first()[0])
            now = now.join(factor.select(axis, "f"), axis).select(*AXES, "tokens", (F.col("x") * F.col("f")).alias("x"))
        now = stored(now, "raked")
        if worst < CLOSE:
            break
    _settled(worst)
    rated = now.withColumn("weight", F.col("x") / F.col("tokens"))
    ends = rated.where("weight > 0").agg(F.min("weight").alias("a"), F.max("weight").alias("z")).first()
    high = 0.0
    if ends["a"]:
        low, high = np.log(min(1.0, budget) / ends["z"]) - 1, -np.log(ends["a"])  # of the scale's logarithm
        for _ in range(60):
            mid = (low + high) / 2
            some = rated.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * float(np.exp(mid))) * F.col("tokens"))).first()[0]
            low, high = (mid, high) if some < budget * total else (low, mid)
        high = float(np.exp(high))
    return rated.select(*AXES, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET_SHARE, topic_of: Column | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """For each row of ``docs``: doc (its columns), tokens, source, lang, topic, weight, probability and selected.

    ``targets`` has shares by axis and value, e.g. {"lang": {"en": 0.5, "de": 0.5}}; ``budget`` is the share of all tokens to keep.
    """
    rows = with_cells(docs, topic_of)
    cells = stored(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")), "cells")
    n = cells.count()
    if not n:
        return rows.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"), F.lit(False).alias("selected"))
    odds = _probabilities_local(docs.sparkSession, cells, targets, budget) if n <= local_cells else stored(_probabilities_spread(cells, targets, budget), "odds")
    if n <= BROADCAST_CELLS:
        odds = F.broadcast(odds)
    draw = F.xxhash64(F.lit(SEED), F.col("doc.doc_id"), F.col("doc.text")).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return rows.join(odds, list(AXES)).withColumn("selected", draw < F.col("probability"))


def document_mix(documents: DataFrame) -> DataFrame:
    out = sampled(documents.select("doc_id", "source", "lang", "text"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.lang").alias("lang"), "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "selected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sample keeps, with their columns as they are."""
    modest(spark)
    return sampled(docs).where("selected").select("doc.*")
