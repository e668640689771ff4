"""Mixing sources to target weights.

The shares of a mix come from its sources' token shares by exponents: w(t) is in proportion to target**(1-t) * share**t,
so t = 0 asks for the targets and t = 1 for the sources as they are; the least t at which no source would have to repeat
more often than allowed is found by bisection. A mix whose t is above 0 has sources that fall short at their targets.
With no targets, shares**a is used, and a is bisected to an entropy; limits move it towards the sources as they are in
the same way. Where no t is within the limits, the sources as they are (t = 1) are drawn, those above their limits at
these and the others the more: a mix is smaller than asked only where all its sources together are too small.
Weights become records by budgets: whole passes over a source, then one further pass over permuted blocks of records
until the rest of the budget is used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

DOCS_PER_BLOCK = 4096
EVENNESS = 0.95  # entropy of a mix without targets, as a share of the greatest (all its sources alike)


def entropy(w: np.ndarray) -> float:
    w = w[w > 0] / w.sum()
    return float(-(w * np.log(w)).sum())


def exponent_for_entropy(shares: np.ndarray, target: float, steps: int = 60) -> float:
    """The exponent a for which shares**a, normalised, has the target entropy (a falls from 64 to 0 as entropy rises)."""
    p = shares[shares > 0]
    lo, hi = 0.0, 64.0
    for _ in range(steps):
        a = (lo + hi) / 2
        w = np.exp(a * (np.log(p) - np.log(p).max()))
        lo, hi = (a, hi) if entropy(w) > target else (lo, a)
    return (lo + hi) / 2


def tempered(target: np.ndarray, share: np.ndarray, t: float) -> np.ndarray:
    """Weights at exponent t; a source without tokens or target gets none while another has some."""
    ok = (target > 0) & (share > 0)
    w = np.zeros(len(target))
    w[ok] = np.exp((1 - t) * np.log(target[ok]) + t * np.log(share[ok]))
    return w / w.sum() if w.sum() > 0 else w


def exponent_within_limits(target: np.ndarray, share: np.ndarray, most: np.ndarray, steps: int = 60, grid: int = 256) -> float | None:
    """The least t in [0, 1], to within 1/grid, from which no weight exceeds `most` (the share a source reaches at its limit); None if there is none.

    A weight may rise and fall again with t, so the first t of a grid that fits is looked for, and then bisected down.
    """
    fits = lambda t: bool(np.all(tempered(target, share, t) <= most * (1 + 1e-12)))
    if np.all(target <= most) and fits(0.0):
        return 0.0
    hi = next((t for t in np.linspace(0, 1, grid + 1)[1:] if fits(t)), None)
    if hi is None:
        return None
    lo = hi - 1 / grid
    for _ in range(steps):
        t = (lo + hi) / 2
        lo, hi = (lo, t) if fits(t) else (t, hi)
    return float(hi)


def filled(weights: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Weights with those above `most` cut to it and the rest scaled up to make good for it, as far as all limits allow."""
    w, full = weights.copy(), np.zeros(len(weights), bool)
    while True:
        over = ~full & (w > most * (1 + 1e-12))
        if not over.any():
            return w
        full |= over
        free = np.where(full, 0.0, weights)
        w = np.where(full, most, free / free.sum() * max(0.0, 1 - most[full].sum()) if free.sum() > 0 else 0.0)


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, tokens, docs from records with source and n_tokens; a source of any size is added up before its shuffle."""
    return sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def plan_mixes(sized: DataFrame, targets: DataFrame, evenness: float = EVENNESS) -> DataFrame:
    """For each mix and source: tokens, docs, share (scaled target), budget, allowed (tokens at the repetition limit; null: none), short, draw, actual_share, exponent and tempered_share.

    sized has source and n_tokens of every record; targets has mix_id, source, target_share, max_repeats (null: no
    limit) and size_ratio. Repeated target rows count once; rows with a null or negative share count as 0, those
    without a mix or source are left out, and shares are scaled to add up to 1. The size of a mix is size_ratio times
    the tokens of all records, those of a null source included. A source without records has 0 tokens and falls short
    of any share above 0. share, budget and short are of the targets. draw is tempered_share of the size of the mix at the
    least exponent within the limits; exponent is null if not even the sources as they are fit, and tempered_share then
    is what these come to within the limits (see filled; less than 1 in all if all limits together do not suffice). A mix whose shares are all null has no targets: its weights are powers of the sources' token
    shares with `evenness` of the greatest entropy, its exponent is that power, and no source of it is short.
    """
    sizes = cut_lineage(source_sizes(sized))  # a row per source, read twice below: the records are counted once
    rows = targets.select("mix_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.col("target_share").isNotNull().alias("given"), "max_repeats", F.coalesce("size_ratio", F.lit(0.0)).alias("size_ratio")).where("mix_id IS NOT NULL AND source IS NOT NULL").distinct()
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    joined = rows.join(sizes, "source", "left").fillna(0, ["tokens", "docs"]).crossJoin(F.broadcast(total))  # one row

    def mix(pdf: pd.DataFrame) -> pd.DataFrame:
        given = bool(pdf["given"].any())
        pdf = pdf.drop(columns="given").drop_duplicates().sort_values(["source", "target_share"]).reset_index(drop=True)
        q = pdf["target_share"].to_numpy(float)
        q = q / q.sum() if q.sum() > 0 else q
        tokens = pdf["tokens"].to_numpy(float)
        size = pdf["size_ratio"].to_numpy(float) * float(pdf["total"].iloc[0])
        limit = pdf["max_repeats"].astype("Float64").to_numpy(float, na_value=np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            allowed = np.where(np.isinf(limit), np.where(tokens > 0, np.inf, 0.0), tokens * limit)
            most = np.where(size > 0, allowed / size, np.inf)
        budget = q * size
        p = tokens / pdf.groupby("source")["source"].transform("size").to_numpy()  # a source of several rows counts once
        p = p / p.sum() if p.sum() > 0 else p
        wanted, a = q, 0.0
        if not given and p.sum() > 0:
            a = exponent_for_entropy(p, evenness * np.log((p > 0).sum()))
            wanted = tempered(np.where(p > 0, 1.0, 0.0), p**a, 1.0)
        t = exponent_within_limits(wanted, p, most)
        weights = filled(tempered(wanted, p, 1.0), most) if t is None else tempered(wanted, p, t)
        draw = np.minimum(weights * size, allowed)
        exponent = np.nan if t is None else a + t * (1 - a)  # (p**a)**(1-t) * p**t, with targets a is 0 and this is t
        return pdf.assign(share=q, budget=budget, allowed=np.where(np.isinf(allowed), np.nan, allowed), short=(allowed < budget), draw=draw, actual_share=draw / draw.sum() if draw.sum() > 0 else 0.0, exponent=exponent, tempered_share=weights)[[f.split()[0] for f in schema.split(", ")]]

    schema = "mix_id string, source string, tokens bigint, docs bigint, share double, budget double, allowed double, short boolean, draw double, actual_share double, exponent double, tempered_share double"
    out = joined.groupBy("mix_id").applyInPandas(mix, schema)  # a mix has as many rows as it names sources
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("allowed", "exponent")})


def draw_records(sized: DataFrame, plan: DataFrame, seed: int = 0, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """mix_id, source, doc_id, repeats, n_tokens: how often each record is drawn into each mix (records drawn 0 times are left out).

    Each source gives as many whole passes as its draw holds, then the records of a further pass in an order permuted
    by block and within blocks, up to the first record that would exceed the rest. The order depends on seed, mix
    and doc_id only. Only block totals and one block per source are ordered, never a whole source.
    """
    want = plan.where("tokens > 0 AND draw > 0").groupBy("mix_id", "source").agg(F.first("tokens").alias("tokens"), F.first("docs").alias("docs"), F.sum("draw").alias("draw"))
    want = want.withColumns({"passes": F.floor(F.col("draw") / F.col("tokens")), "blocks": F.ceil(F.col("docs") / docs_per_block)})
    want = want.withColumn("rest", F.col("draw") - F.col("passes") * F.col("tokens")).drop("draw", "tokens", "docs")
    mixed = sized.where("source IS NOT NULL").select("source", "doc_id", "n_tokens").join(want, "source")
    place = F.xxhash64(F.lit(seed), "mix_id", "doc_id")
    mixed = mixed.withColumns({"block": F.pmod(place, F.col("blocks")), "place": F.xxhash64(F.lit(seed + 1), "mix_id", "doc_id")})
    totals = mixed.groupBy("mix_id", "source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    before = F.sum("block_tokens").over(Window.partitionBy("mix_id", "source").orderBy("block"))
    reached = totals.withColumn("start", before - F.col("block_tokens"))
    kinds = reached.select("mix_id", "source", "block", "start", (F.col("start") + F.col("block_tokens") <= F.col("rest")).alias("whole"), (F.col("start") < F.col("rest")).alias("touched"))
    located = mixed.join(kinds, ["mix_id", "source", "block"])
    cut = located.where("touched AND NOT whole")  # one block of each source
    upto = F.sum("n_tokens").over(Window.partitionBy("mix_id", "source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = cut.withColumn("more", (F.col("start") + upto <= F.col("rest")).cast("bigint"))
    whole = located.where("NOT touched OR whole").withColumn("more", F.col("whole").cast("bigint"))
    return whole.unionByName(part).select("mix_id", "source", "doc_id", (F.col("passes") + F.col("more")).alias("repeats"), "n_tokens").where("repeats > 0")


def drawn_shares(drawn: DataFrame) -> DataFrame:
    """mix_id, source, records, drawn_tokens and actual_share of each source in what was drawn."""
    per = drawn.groupBy("mix_id", "source").agg(F.sum("repeats").alias("records"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("drawn_tokens"))
    return per.withColumn("actual_share", F.col("drawn_tokens") / F.sum("drawn_tokens").over(Window.partitionBy("mix_id")))
