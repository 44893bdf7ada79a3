"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into pieces of up to four characters of a word. A k-mer of pieces
is chosen if the smallest hash of its inner s-mers stands at its first or last
place: whether it is chosen depends on nothing around it, so equal passages have
equal anchors wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = r"[^\x20\x09-\x0D]{1,4}"
K, S = 5, 2  # pieces in a k-mer and in an inner s-mer
SKETCH = 64  # smallest distinct anchor hashes that make a fingerprint
BUCKET_ROWS, MAX_BUCKETS = 2_000, 2_048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hashes(text: Column) -> Column:
    """Per piece the hash of the s-mer that starts there; the last one is short."""
    return let(
        F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)),
        lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))),
    )


def anchors(text: Column) -> Column:
    """array<struct(hash, at)>: the closed syncmers of a text by place; ``at`` counts pieces.

    A text of fewer than K pieces has one anchor for all of it, a blank one none.
    """

    def chosen(s: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            inner = F.least(x, F.get(s, i + 1), F.get(s, i + 2), F.get(s, i + 3))
            edge = (i <= F.size(s) - K) & ((inner == x) | (inner == F.get(s, i + 3)))
            return F.when(edge, F.struct(F.xxhash64(x, F.get(s, i + 2), F.get(s, i + 3)).alias("hash"), i.alias("at")))

        short = F.array(F.struct(F.xxhash64(s).alias("hash"), F.lit(0).alias("at")))
        return F.when(F.size(s) >= K, F.array_compact(F.transform(s, at))).when(F.size(s) > 0, short).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))

    return let(hashes(F.coalesce(text, F.lit(""))), chosen)


def sketch(text: Column) -> Column:
    """The SKETCH smallest distinct 32-bit anchor hashes, ascending; equal texts have equal sketches."""

    def chosen(s: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            inner = F.least(x, F.get(s, i + 1), F.get(s, i + 2), F.get(s, i + 3))
            return F.when((i <= F.size(s) - K) & ((inner == x) | (inner == F.get(s, i + 3))), F.shiftrightunsigned(F.xxhash64(x, F.get(s, i + 2), F.get(s, i + 3)), 32))

        short = F.array(F.shiftrightunsigned(F.xxhash64(s), 32))
        return F.when(F.size(s) >= K, F.array_compact(F.transform(s, at))).when(F.size(s) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.array_sort(F.array_distinct(let(hashes(F.coalesce(text, F.lit(""))), chosen))), 1, SKETCH)


def fingerprint(sketched: Column) -> Column:
    """A sketch as lowercase hex, eight digits a hash; empty for a text without words."""
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the smallest hashes of both that both sketches hold (an estimate of Jaccard similarity); 1 for two empty ones."""
    return let(
        F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)),
    )


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id) with ``_bucket``: ranges of doc_id of about BUCKET_ROWS rows, in order; null ids come last."""
    counted = docs.agg(F.count("*").alias("n")).first()["n"]
    buckets = min(MAX_BUCKETS, max(1, counted // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()["c"] if buckets > 1 else []
    edges = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<bigint>")
    return docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(MAX_BUCKETS)).otherwise(F.size(F.filter(edges, lambda e: e < F.col("doc_id")))))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketched, next_text, next_sketched): each row beside the next by doc_id, after the last the first.

    Rows are dealt over ranges of doc_id and read beside their neighbour there; the
    last row of a range takes the first of the next one, of which there is one per
    range. Equal ids are ordered by text; null texts count as empty, null ids come
    last. Texts are shuffled once.
    """
    rows = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    first = rows.groupBy("_bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text"))["text"].alias("first_text"))
    line = Window.orderBy("_bucket")  # one row per range
    first = first.select("_bucket", "first_text", (F.row_number().over(line) - 1).alias("_no"), F.count("*").over(Window.partitionBy()).alias("_all"))
    turned = first.select(((F.col("_no") - 1 + F.col("_all")) % F.col("_all")).alias("_no"), "first_text", sketch(F.col("first_text")).alias("first_sketched"))
    turned = first.select("_bucket", "_no").join(turned, "_no").drop("_no")
    beside = Window.partitionBy("_bucket").orderBy(*order)
    told = rows.withColumn("sketched", sketch(F.col("text"))).select(
        "*", F.lead("text").over(beside).alias("_text"), F.lead("sketched").over(beside).alias("_sketched"),
    )
    return told.join(turned, "_bucket").select(
        "doc_id", "text", "sketched", F.coalesce("_text", "first_text").alias("next_text"), F.coalesce("_sketched", "first_sketched").alias("next_sketched"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs`` (doc_id, text).

    The edited text replaces the last floor(n_chars / 2) code points by as many of
    the next document's first (or all, if it has fewer). Likeness is estimated
    from the fingerprints alone. A single document is its own next.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sketched", "next_sketched", edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketched"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketched")).alias("fingerprint"), fingerprint(F.col("edited_sketched")).alias("edited_fingerprint"),
        likeness(F.col("sketched"), F.col("edited_sketched")).alias("near_edited"), likeness(F.col("sketched"), F.col("next_sketched")).alias("near_next"),
    )
