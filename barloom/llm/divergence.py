"""Divergence of the sources of each language: equal texts are collapsed and tokenized once, pairs are evaluated from sparse counts.

A term that a source lacks has the source's base share. With b the bases and f the
divergence of two shares, the sum over all kept terms of two sources s and t is
V f(b_s, b_t), plus f(p_s, b_t) - f(b_s, b_t) over the terms of s and the same over those of t,
plus f(p_s, p_t) - f(p_s, b_t) - f(b_s, p_t) + f(b_s, b_t) over the terms of both. The second
part needs only how often each share occurs in a source; the last one is summed in
buckets of terms, each of which returns one row per pair of sources it holds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
HELD_TERMS, HELD_BYTES = 300_000, 1 << 27  # a task passes its counters on at so many, or after so much text
BUCKET_ROWS = 100_000  # counts in a bucket of terms
PAIRS = 1 << 18  # pairs of counts evaluated at a time
PART = 1 << 20  # bytes of a text that are split at a time
#: ASCII letters lower-cased, other ASCII to spaces; bytes of other characters stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128)) + bytes(range(128, 256))
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in portions: runs of ASCII letters and of characters beyond ASCII."""
    a = 0
    while a < len(text):
        end = BREAK.search(text, a + PART)
        b = end.end() if end else len(text)
        yield text[a:b].translate(TERMS).split()
        a = b


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, held): every text of a language once, with the sources that hold it and how often.

    Multiplicities are counted by digest. While the digests of repeated texts are
    few enough for a broadcast, only repeated texts are shuffled; else all are.
    """
    named = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    held = named.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    held = held.groupBy("lang", "digest").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("held"), F.sum("n").alias("copies"))  # a row per source, not per document
    held = stored(held.where("copies > 1").drop("copies"))
    repeated = small_side(held.select("lang", "digest"))
    once = named.join(repeated, ["lang", "digest"], "left_anti")
    copies = named.join(repeated, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.first("text").alias("text")).join(held, ["lang", "digest"])
    return once.select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("held")).unionByName(copies.select("lang", "text", "held"))


def counted(texts: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs) of ``texts`` (lang, text, held): occurrences in a source, and documents that hold the term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def told() -> pd.DataFrame:
            rows = [(lang, term.decode(), source, n, docs[term]) for (lang, source), (times, docs) in found.items() for term, n in times.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["lang", "term", "source", "n", "docs"])

        for b in batches:
            for lang, text, held in zip(b["lang"], b["text"], b["held"]):
                own: Counter = Counter()
                for words in terms(text):
                    own.update(words)
                for h in held:
                    (times, docs), n = found[lang, h["source"]], h["n"]
                    if n == 1:
                        times.update(own)
                        docs.update(own.keys())
                    else:
                        for term, k in own.items():
                            times[term] += n * k
                            docs[term] += n
                size += len(text)
                if size > HELD_BYTES or len(held) > 1 and sum(len(t) for t, _ in found.values()) > HELD_TERMS:
                    yield told()
                    size = 0
            if sum(len(t) for t, _ in found.values()) > HELD_TERMS:
                yield told()
                size = 0
        yield told()

    parts = texts.select("lang", F.col("text").cast("binary").alias("text"), "held").mapInPandas(count, "lang string, term string, source string, n long, docs long")
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)) in whole numbers."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)")) + 1


def differ(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pairs_of(start: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of the ``k`` holders of each term that starts at ``start``, about PAIRS at a time."""
    if k * (k - 1) // 2 <= PAIRS:
        i, j = np.triu_indices(k, 1)
        step = max(1, PAIRS // max(1, len(i)))
        for a in range(0, len(start), step):
            at = start[a : a + step, None]
            yield (at + i).ravel(), (at + j).ravel()
    else:
        for s in start:
            for i in range(k - 1):
                y = np.arange(s + i + 1, s + k)
                yield np.full(len(y), s + i), y


def shared_terms(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(one, two, value) for the pairs of sources that share terms of one bucket, one < two."""
    at, names = pd.factorize(rows["source"], sort=True)
    term = pd.factorize(rows["term"])[0]
    order = np.lexsort((at, term))
    term, at, p, base = term[order], at[order].astype(np.int64), rows["p"].to_numpy(np.int64)[order], rows["base"].to_numpy(np.int64)[order]
    start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    holders = np.diff(np.r_[start, len(term)])
    values: dict[int, int] = defaultdict(int)
    for k in np.unique(holders[holders > 1]):
        for x, y in pairs_of(start[holders == k], int(k)):
            v = f(p[x], p[y]) - f(p[x], base[y]) - f(base[x], p[y]) + f(base[x], base[y])
            pair, which = np.unique(at[x] * len(names) + at[y], return_inverse=True)
            sums = np.zeros(len(pair), np.int64)
            np.add.at(sums, which, v)
            for a, s in zip(pair.tolist(), sums.tolist()):
                values[a] += s
    pairs = np.fromiter(values, np.int64, len(values))
    one, two = np.asarray(names, object)[pairs // len(names)], np.asarray(names, object)[pairs % len(names)]
    return pd.DataFrame({"lang": key[0], "one": one, "two": two, "value": np.fromiter(values.values(), np.int64, len(values))})


def own_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(one, two, value) for each source and all others of its language: what the source's own terms add, and all terms at the bases."""
    for b in batches:
        for lang, source, base, kept, first, shares, others in zip(*(b[c] for c in ("lang", "source", "base", "kept", "first", "shares", "others"))):
            p, n = (np.array([s[c] for s in shares], np.int64) for c in ("p", "n"))
            rows = []
            for o in others:
                if o["source"] != source:
                    value = int(((f(p, np.int64(o["base"])) - f(np.int64(base), np.int64(o["base"]))) * n).sum())
                    if first and source < o["source"]:
                        value += int(f(np.int64(base), np.int64(o["base"]))) * kept
                    rows.append((lang, min(source, o["source"]), max(source, o["source"]), value))
            yield pd.DataFrame(rows, columns=["lang", "one", "two", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language by divergence, all ranks.
    Part ``term``: the ``top`` terms that a source uses more than its language.
    Terms in fewer than ``least_docs`` documents (rows) of a language are left out. Null
    text, lang and source count as empty, repeated rows each count, ties go by
    the item's bytes, a language without kept terms has pairs of value 0, an empty table gives no row.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    term = Window.partitionBy("lang", "term")  # a row per source
    counts = counted(collapsed(docs)).withColumn("docs", F.sum("docs").over(term)).withColumn("whole", F.sum("n").over(term))
    sparse = stored(counts.where(F.col("docs") >= least_docs).drop("docs"))
    kept = sparse.groupBy("lang", "term").agg(F.first("whole").alias("whole"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    sizes = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    base = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(1))
    groups = stored(groups.withColumn("base", base).withColumn("buckets", F.ceil(F.sum("terms").over(Window.partitionBy("lang")) / BUCKET_ROWS)))

    shares = stored(
        sparse.join(small_side(groups), ["lang", "source"])
        .select("lang", "source", "term", "n", "base", "buckets", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("whole"), F.col("lang_total"), F.col("kept")).alias("q"))
    )
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket")
    both = shares.select("lang", bucket, "term", "source", "p", "base").groupBy("lang", "bucket").applyInPandas(shared_terms, "lang string, one string, two string, value long")
    # how often each share occurs in a source, dealt so that no row holds more than a few thousand shares
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    often = often.groupBy("lang", "source", F.pmod(F.col("p"), F.lit(16)).alias("slice")).agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    often = often.unionByName(groups.select("lang", "source", F.lit(-1).cast("long").alias("slice"), F.array().cast("array<struct<p:bigint,n:bigint>>").alias("shares")))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "base")).alias("others"))  # a row per source
    alone = often.join(groups.select("lang", "source", "base", "kept"), ["lang", "source"]).join(others, "lang")
    alone = alone.select("lang", "source", "base", "kept", (F.col("slice") < 0).alias("first"), "shares", "others").mapInPandas(own_terms, "lang string, one string, two string, value long")
    pairs = both.unionByName(alone).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    return (
        pairs.withColumn("rank", F.row_number().over(by_value))
        .unionByName(above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))
    )


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), t AS (
  SELECT g.lang, g.source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS total FROM g
), p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total::HUGEINT + 2 * v.v) AS HUGEINT) AS p
  FROM t JOIN kept ON kept.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term
), q AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS HUGEINT) AS q
  FROM p GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
) WHERE rank <= 10
"""
