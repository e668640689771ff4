"""Queries of the training-data problems: p2 (percentiles), p5 (top N), p7 (token ids), p8 (mixes), p9 (subjects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import count_tokens, decode_ids, encode_texts
from tessera.llm.mixing import draw_records, drawn_shares, plan_mixes
from tessera.llm.percentiles import TINY, build_sketches, merge_sketches, percentiles
from tessera.llm.subjects import LEAST_SHARE, MOST_LABELLED, VOTES, assign_subjects, voted
from tessera.llm.topn import top_n
from tessera.session import cut_lineage, table

VOCABULARY = "byte_bpe_50k.tiktoken"
QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def _prices(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "order_items").groupBy("oi_id").agg(F.min(F.struct("oi_loaded_at", "oi_product_id", "oi_unit_price")).alias("r"))
    return once.select(F.concat(F.lit("product "), F.col("r.oi_product_id")).alias("group_key"), F.col("r.oi_unit_price").alias("value"), F.col("r.oi_loaded_at").alias("loaded"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "oltp_orders").groupBy("o_id").agg(F.min(F.struct("o_loaded_at", "o_status", "o_total")).alias("r"))
    return once.select("o_id", F.concat(F.lit("state "), F.lower(F.trim("r.o_status"))).alias("group_key"), F.col("r.o_total").alias("value"), F.col("r.o_loaded_at").alias("loaded"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _prices(spark, d).unionByName(_totals(spark, d).drop("o_id"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(build_sketches(_values(spark, d)), QUANTILES)


def p2_merged_months(spark: SparkSession, d: str) -> DataFrame:
    """The same from one sketch for each group and month of loading, added up afterwards."""
    monthly = build_sketches(_values(spark, d).withColumn("month", F.date_format("loaded", "yyyy-MM")), ("group_key", "month"))
    return percentiles(merge_sketches(monthly), QUANTILES)


def p2_months_agree(spark: SparkSession, d: str) -> DataFrame:
    """Per group, whether months merged give the counts and percentiles of one pass over all rows."""
    a, b = p2_merged_months(spark, d), p2_percentiles(spark, d)
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    alike = same("n")
    for q in QUANTILES:
        alike &= same(f"p{round(q * 100):02d}")
    return a.alias("a").join(b.alias("b"), "group_key", "full").select("group_key", F.col("a.n").alias("n"), alike.alias("alike"))


def p2_after_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Per state, how many orders are left, and whether their percentiles lie within the stated bounds, once the orders that key_deletions names as deleted have been subtracted from the sketches of all."""
    gone = table(spark, d, "key_deletions").where("table_name = 'oltp_orders' AND restored_at IS NULL").select(F.col("key_id").alias("o_id")).distinct()
    values = _totals(spark, d)
    taken = values.join(gone, "o_id", "left_semi").withColumn("weight", F.lit(-1))
    left = merge_sketches(build_sketches(values).unionByName(build_sketches(taken)))
    return _within_bounds(values.join(gone, "o_id", "left_anti"), percentiles(left, QUANTILES))


def p2_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per group, how many values it has, and whether the exact ranks of its estimates lie within the stated bounds."""
    return _within_bounds(_values(spark, d), p2_percentiles(spark, d))


def _within_bounds(values: DataFrame, est: DataFrame) -> DataFrame:
    values = values.where("group_key IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    named = [(q, f"p{round(q * 100):02d}") for q in QUANTILES]
    slack = lambda c, s: F.col(c) + s * (F.abs(F.col(c)) * 2.0**-14 + TINY)
    both = values.join(est, "group_key")
    counts = [x for q, p in named for x in (F.sum((F.col("value") <= slack(p, 1)).cast("bigint")).alias(f"le_{p}"), F.sum((F.col("value") < slack(p, -1)).cast("bigint")).alias(f"lt_{p}"))]
    per = both.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.first("n").alias("n_sketch"), F.first("rank_error").alias("rank_error"), *counts)
    fine = F.col("n") == F.col("n_sketch")
    for q, p in named:
        rank = F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1))
        fine &= (F.col(f"le_{p}") + F.col("rank_error") * F.col("n") >= rank) & (F.col(f"lt_{p}") - F.col("rank_error") * F.col("n") < rank)
    return per.select("group_key", "n", fine.alias("within_bounds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for name, t, branch, nation, score, key in (("customer", "customer_primary", "c_branch", "c_nationkey", "c_acctbal", "c_custkey"), ("supplier", "supplier_list", "s_branch", "s_nationkey", "s_acctbal", "s_suppkey")):
        top = top_n(table(spark, d, t), [branch, nation], score, key, 5)
        out.append(top.select(F.lit(name).alias("table_name"), F.col(branch).alias("branch"), F.col(nation).alias("nationkey"), F.col(key).alias("row_key")))
    return out[0].unionByName(out[1])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text", *vocabulary())


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"), "doc_id", "text", *vocabulary(), keep=("source",))


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_mixes(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_plan(spark, d).where("short").select("mix_id", "source").distinct()


def p8_drawn_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = cut_lineage(_sized(spark, d))  # read several times below
    return drawn_shares(draw_records(sized, plan_mixes(sized, table(spark, d, "mix_targets"))))


def p8_even(spark: SparkSession, d: str) -> DataFrame:
    """All sources of the corpus mixed to an entropy: how many there are, and the mix's entropy as a share of the greatest."""
    sized = cut_lineage(_sized(spark, d))
    sources = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    none = {"target_share": F.lit(None).cast("double"), "max_repeats": F.lit(None).cast("int"), "size_ratio": F.lit(1.0)}
    plan = plan_mixes(sized, sources.select(F.lit("even").alias("mix_id"), "source", *[c.alias(k) for k, c in none.items()]))
    h = F.sum(-F.col("actual_share") * F.log("actual_share"))
    return plan.groupBy("mix_id").agg(F.count(F.lit(1)).alias("sources"), F.round(h / F.log(F.count(F.lit(1))), 6).alias("evenness"))


def p8_realised(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source with a share, whether the tokens drawn are those planned to within one record."""
    sized = cut_lineage(_sized(spark, d))
    plan = cut_lineage(plan_mixes(sized, table(spark, d, "mix_targets")))  # a row per mix and source
    drawn = drawn_shares(draw_records(sized, plan)).select("mix_id", "source", "drawn_tokens")
    longest = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    want = plan.where("draw > 0").groupBy("mix_id", "source").agg(F.sum("draw").alias("draw"))
    got = F.coalesce(F.col("drawn_tokens"), F.lit(0))
    near = (got <= F.col("draw") + 1e-3) & (got > F.col("draw") - F.col("longest") - 1e-3)
    return want.join(drawn, ["mix_id", "source"], "left").join(longest, "source").select("mix_id", "source", near.alias("realised"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text decoded from its ids; a null text comes back empty."""
    path, pattern = vocabulary()
    return decode_ids(p7_ids(spark, d), "doc_id", "ids", path, pattern)


def _p9(spark: SparkSession, d: str, what=assign_subjects):
    rows = table(spark, d, "subjects").orderBy("subject").collect()  # a fixed table
    words = {r["subject"]: f"{r['title'] or ''}. {r['description'] or ''}" for r in rows}
    return what(table(spark, d, "documents"), table(spark, d, "subject_labels"), list(words), MOST_LABELLED, LEAST_SHARE, words, cut_lineage)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d).select("doc_id", "subject")


def p9_model(spark: SparkSession, d: str) -> DataFrame:
    """What the label model changed: pairs of document and subject in all, those on which the lexicon abstained, and those decided against the count of sentences."""
    votes, posterior = _p9(spark, d, voted)
    rows = votes.join(F.broadcast(posterior), ["subject_no", *VOTES])
    n = lambda c: F.sum(c.cast("bigint"))
    yes = F.col("posterior") > 0.5
    return rows.agg(F.count(F.lit(1)).alias("pairs"), n(F.col("lexicon") == 0).alias("abstained"), n(yes).alias("assigned"), n(~yes & F.col("counted")).alias("overruled_to_no"), n(yes & ~F.col("counted")).alias("overruled_to_yes"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per subject, how many documents are about it and their share of the corpus."""
    total = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("total"))
    per = _p9(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return per.crossJoin(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))  # one row


QUERIES = {"p2_percentiles": p2_percentiles, "p2_merged_months": p2_merged_months, "p2_within_bounds": p2_within_bounds, "p2_months_agree": p2_months_agree, "p2_after_deletions": p2_after_deletions, "p5_found": p5_found, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_plan": p8_plan, "p8_found": p8_found, "p8_drawn_shares": p8_drawn_shares, "p8_even": p8_even, "p8_realised": p8_realised, "p9_found": p9_found, "p9_shares": p9_shares, "p9_model": p9_model}


def _top(name: str, t: str, p: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, CAST({p}_branch AS BIGINT) AS branch, CAST({p}_nationkey AS BIGINT) AS nationkey, {key} AS row_key FROM (
  SELECT *, row_number() OVER (PARTITION BY {p}_branch, {p}_nationkey ORDER BY round({p}_acctbal * 100) DESC, {key}) AS rn
  FROM (SELECT DISTINCT {key}, {p}_nationkey, {p}_branch, {p}_acctbal FROM {t} WHERE {p}_nationkey IS NOT NULL AND {p}_branch IS NOT NULL AND {p}_acctbal IS NOT NULL AND NOT isnan({p}_acctbal))) WHERE rn <= 5"""


_GROUPS = """SELECT DISTINCT oi_id, 'product ' || oi_product_id AS group_key, oi_unit_price AS value FROM order_items
  UNION ALL SELECT DISTINCT o_id, 'state ' || lower(trim(o_status)), o_total FROM oltp_orders"""
_COUNTED = "WHERE group_key IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1"

ORACLES = {
    "p2_within_bounds": f"SELECT group_key, count(*) AS n, true AS within_bounds FROM ({_GROUPS}) {_COUNTED}",
    "p2_months_agree": f"SELECT group_key, count(*) AS n, true AS alike FROM ({_GROUPS}) {_COUNTED}",
    "p2_after_deletions": f"""SELECT group_key, count(*) AS n, true AS within_bounds FROM (SELECT DISTINCT o_id, 'state ' || lower(trim(o_status)) AS group_key, o_total AS value FROM oltp_orders
  WHERE o_id NOT IN (SELECT key_id FROM key_deletions WHERE table_name = 'oltp_orders' AND restored_at IS NULL)) {_COUNTED}""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_even": "SELECT 'even' AS mix_id, count(DISTINCT source) AS sources, CAST(0.95 AS DOUBLE) AS evenness FROM documents WHERE text <> ''",
    "p8_realised": "SELECT DISTINCT mix_id, source, true AS realised FROM mix_targets WHERE target_share > 0 AND size_ratio > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
    "p5_found": _top("customer", "customer_primary", "c", "c_custkey") + " UNION ALL " + _top("supplier", "supplier_list", "s", "s_suppkey"),
}
