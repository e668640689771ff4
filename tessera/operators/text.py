"""Tokens, inverted index, chunks and hybrid ranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.schema import number_rows

# The words that the index leaves out.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "as", "is", "was", "are", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must",
    "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
]


def words(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case words (letters, digits and _) of two or more bytes that are no stop words, in order; [] for NULL."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: F.octet_length(x) > 1)
    return F.filter(w, lambda x: ~x.isin(stop)) if stop else w


def cjk_grams(text: Column) -> Column:
    """Single Chinese signs and pairs of neighbours."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([一-鿿]+)"), 1)
    grams = F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.when(i < F.length(r), F.array(F.substring(r, i, F.lit(1)), F.substring(r, i, F.lit(2)))).otherwise(F.array(F.substring(r, i, F.lit(1)))))))
    return F.flatten(grams)


def terms(text: Column) -> Column:
    """Words and Chinese grams, each once, sorted."""
    return F.array_sort(F.array_distinct(F.concat(words(text), cjk_grams(text))))


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, tf."""
    return docs.select(F.col(id_col), F.explode(F.concat(words(F.col(text)), cjk_grams(F.col(text)))).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


def search_all(index: DataFrame, query: list[str], id_col: str = "doc_id") -> DataFrame:
    """Documents that hold every term."""
    q = sorted(set(query))
    return index.where(F.col("term").isin(q)).groupBy(id_col).agg(F.countDistinct("term").alias("_n")).where(F.col("_n") == len(q)).select(id_col)


def search_fuzzy(index: DataFrame, query: list[str], distance: int = 1, id_col: str = "doc_id") -> DataFrame:
    """doc_id and score: how many query terms have an index term within the edit distance."""
    # the distinct terms are compared, not the postings
    q = F.array(*[F.lit(x) for x in sorted(set(query))])
    near = index.select("term").distinct().select("term", F.explode(F.filter(q, lambda w: F.levenshtein(w, F.col("term")) <= distance)).alias("hit"))
    return index.join(near, "term").groupBy(id_col).agg(F.countDistinct("hit").alias("score"))


def keyword_scores(index: DataFrame, query: list[str], id_col: str = "doc_id") -> DataFrame:
    """doc_id and score: sum over query terms of tf * ln(1 + N / df), N being the documents in the index."""
    n = index.select(F.countDistinct(id_col).alias("_n"))
    df = index.where(F.col("term").isin(query)).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    hits = index.where(F.col("term").isin(query)).join(df, "term").crossJoin(F.broadcast(n))  # one row
    return hits.groupBy(id_col).agg(F.sum(F.col("tf") * F.log(1 + F.col("_n") / F.col("_df"))).alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], id_col: str = "doc_id", k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """id and score, the weighted sum of 1 / (k + rank) over rankings of (id, score), rank 1 being the highest score, the smaller id of equal ones."""
    parts = []
    for r, w in zip(rankings, weights or [1.0] * len(rankings)):
        ranked = number_rows(r.select(F.struct((-F.col("score")).alias("_low"), F.col(id_col)).alias("_order")), "_order", name="_r")
        parts.append(ranked.select(F.col(f"_order.{id_col}").alias(id_col), (F.lit(w) / (k + F.col("_r"))).alias("_s")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(id_col).agg(F.sum("_s").alias("score"))


def weighted_hybrid(vector: DataFrame, keyword: DataFrame, graph: DataFrame, id_col: str = "doc_id", weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """id and score: 0.5 vector + 0.3 keyword + 0.2 graph score; a missing score is 0."""
    u = None
    for r, w in zip((vector, keyword, graph), weights):
        p = r.select(id_col, (F.col("score") * w).alias("_s"))
        u = p if u is None else u.unionByName(p)
    return u.groupBy(id_col).agg(F.sum("_s").alias("score"))


_BLANK = re.compile(r"\n\s*\n")
SHORT_LINE = 80


def _packed(text: str, size: int) -> list[str]:
    out: list[str] = []
    now: list[str] = []
    length = 0
    for p in _BLANK.split(text):
        if not p.strip():
            continue
        if now and length + 2 + len(p) > size:
            out.append("\n\n".join(now))
            now, length = [], 0
        length += len(p) + (2 if now else 0)
        now.append(p)
    return [*out, "\n\n".join(now)] if now else out


def _section(chunk: str) -> str | None:
    first = chunk.split("\n", 1)[0].strip()
    return first.lstrip("#").strip() if first.startswith("#") else first if len(first.encode()) < SHORT_LINE else None


def chunks(docs: DataFrame, size: int = 500, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index, section_name, content_text, content_hash: paragraphs packed into chunks of up to `size` characters.

    Paragraphs end at blank lines; one longer than `size` is a chunk of its own. section_name is the chunk's first line
    if that is a heading (#) or shorter than SHORT_LINE bytes. Null, empty and blank texts have no chunks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(i, n, c) for i, t in enumerate(part.column(1).to_pylist()) if t for n, c in enumerate(_packed(t, size))]
                ids, index, texts = part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), [r[1] for r in rows], [r[2] for r in rows]
                yield pa.RecordBatch.from_arrays([ids, pa.array(index, pa.int32()), pa.array(map(_section, texts), pa.string()), pa.array(texts, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=[id_col, "chunk_index", "section_name", "content_text", "content_hash"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, chunk_index int, section_name string, content_text string, content_hash string")


def hash_embeddings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", dims: int = 256) -> DataFrame:
    """id and embedding (array<double>), a unit vector of word counts hashed to `dims` places with signs; zeros for a text without words.

    Words are counted per place before they are shuffled, so a long text costs at most `dims` rows; ids must be unique.
    """
    h = F.xxhash64("w")
    sign = F.when(F.pmod(F.shiftrightunsigned(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    each = docs.select(F.col(id_col), F.explode_outer(words(F.col(text), [])).alias("w"))
    counts = each.groupBy(id_col, F.when(F.col("w").isNotNull(), F.pmod(h, F.lit(dims))).alias("p")).agg(F.sum(F.when(F.col("w").isNotNull(), sign)).alias("s"))
    per = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "s")))).alias("m"), F.sqrt(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).alias("length"))
    place = lambda i: F.coalesce(F.try_element_at("m", i) / F.when(F.col("length") > 0, F.col("length")), F.lit(0.0))
    return per.select(id_col, F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), place).alias("embedding"))


def versions(docs: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """Document versions: version_number by time, content_hash, and whether the content changed since the one before."""
    w = Window.partitionBy(key).orderBy(at)  # of hashes: the texts themselves are not sorted
    h = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).drop(text)
    return h.withColumns({"version": F.row_number().over(w), "changed": F.coalesce(F.lag("content_hash").over(w) != F.col("content_hash"), F.lit(True))})


def evidence(chunks_: DataFrame, ids: DataFrame, id_col: str = "doc_id", most: int = 200) -> DataFrame:
    """Snippet and evidence hash of each selected chunk; ids without a chunk give no row."""
    return chunks_.join(ids, id_col, "left_semi").select(id_col, "chunk_index", F.substring("content_text", 1, most).alias("snippet"), F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"), "content_hash"), 256).alias("evidence_hash"))
