"""Line dedup by pairwise alignment: rare shared runs of lines find the pairs, patience diff aligns them, the later document loses the aligned blocks.

Lines are cut further into sentences, so that a passage inside a line goes too;
these are the lines meant below. A run is the least number of neighbouring lines
that holds MIN_WORDS words; runs are what is hashed and aligned, so every aligned
block is long enough. Of all documents that hold a run, the one with the smallest doc_id
introduces it, and a later document is aligned with the introducers of its runs, those of
its rarest runs first. What a diff leaves over (passages in another order,
or more often than in the other document) is aligned again, passage by passage,
until nothing is left. A run that a third of all documents hold gives one row per
occurrence, never a pair per two documents, and nothing is capped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored, unused

MIN_WORDS = 5  # a common block of fewer words is left alone
CUT = re.compile(r"\n|[.!?…][\"')\]”’]?(?=[ \t]+\S)|[。！？](?=\S)")  # where a text is cut into lines, and these into sentences
BLANK = b" \t\r\v\f\n"
RUN_ROWS = 100_000  # runs passed on at a time


def rising(pairs: list[tuple[int, int]]) -> list[int]:
    """Places of a longest stretch of ``pairs`` (ordered by the first number) that rises strictly in the second, by patience sorting."""
    tops, at, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        tops[k : k + 1] = [y]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def alignment(own: list[int]) -> list[int]:
    """Patience diff of a document with another one: places in ``own`` that are aligned.

    ``own`` gives, for the shared runs of the document in order, the place of each
    in the other document. Runs that occur once are the anchors; between two anchors, whatever
    still rises is aligned too.
    """
    times: dict[int, int] = {}
    for y in own:
        times[y] = times.get(y, 0) + 1
    once = [(i, y) for i, y in enumerate(own) if times[y] == 1]
    anchors = [once[k] for k in rising(once)]
    out = [i for i, _ in anchors]
    for (i, low), (j, high) in zip([(-1, -1), *anchors], [*anchors, (len(own), float("inf"))]):
        gap = [(k, own[k]) for k in range(i + 1, j) if low < own[k] < high]
        out += [gap[k][0] for k in rising(gap)]
    return sorted(out)


def aligned(own: list[int]) -> list[int]:
    """Places in ``own`` that fall in a first diff and, passage by passage, in those of what it leaves."""
    out = alignment(own)
    taken = set(out)
    passage: list[int] = []
    for i in [i for i in range(len(own)) if i not in taken] + [-1]:
        if i < 0 or passage and own[i] <= own[passage[-1]]:
            out += [passage[k] for k in alignment([own[p] for p in passage])]
            passage = []
        passage.append(i)
    return sorted(out)


def windows(words: list[int], least: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs from each place on, and up to each place, that hold ``least`` words; they cover every longer run."""
    out, a, n = set(), 0, 0
    for b, w in enumerate(words, 1):
        n += w
        while n - words[a] >= least and a + 1 < b:
            if n - words[b - 1] < least:
                out.add((a, b))
            n, a = n - words[a], a + 1
        if n >= least:
            out.add((a, b))
    return out


def sentences(text: str) -> Iterator[tuple[bytes, int]]:
    """(sentence without the space around it, byte at which it ends in the UTF-8 text) of the sentences that are not blank."""
    at = end = 0
    for cut in CUT.finditer(text):
        raw = text[at : cut.end()].encode()
        at, end = cut.end(), end + len(raw)
        if bare := raw.strip(BLANK):
            yield bare, end - (len(raw) - len(raw.rstrip(BLANK)))
    raw = text[at:].encode()
    if bare := raw.strip(BLANK):
        yield bare, end + len(raw.rstrip(BLANK))


def runs(text: str, min_words: int) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of the runs of a text in order: hash of their sentences, and the bytes they take, with the space before them."""
    found = list(sentences(text))
    ids = [xxhash.xxh64_digest(s) for s, _ in found]
    ends = [0, *(e for _, e in found)]
    for a, b in sorted(windows([len(s.split()) for s, _ in found], min_words)):
        key = ids[a] if b - a == 1 else xxhash.xxh64_digest(b"".join(ids[a:b]))
        yield int.from_bytes(key, "big", signed=True), ends[a], ends[b]


def row_key() -> Column:
    """Tells rows with one doc_id apart by their text."""
    return F.xxhash64("text")


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, row, spans): bytes (begin, end) of the UTF-8 text that an alignment deletes, for each row of ``docs`` (doc_id, text) that loses some.

    ``row`` is the hash of the text: rows with one doc_id and different texts each
    lose what they share with documents of smaller ids, never with each other.
    Sentences are compared without the white space around them. Rows without
    doc_id or text take no part; repeated rows lose the same.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "row", "key", "begin", "end"]
        for b in batches:
            out: list[tuple] = []
            for doc, row, text in zip(b["doc"].tolist(), b["row"].tolist(), b["text"]):
                out += [(doc, row, *r) for r in runs(text, min_words)]
                if len(out) > RUN_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    wide = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), row_key().alias("row"), "text")
    # written out, so that the sides of the join are plain shuffles and the rows of a hot run can be split
    held = stored(wide.mapInPandas(cut, "doc long, row long, key long, begin int, end int"))
    first = held.groupBy("key").agg(F.min(F.struct("doc", "begin")).alias("first"), F.max("doc").alias("last"), F.count("*").alias("often"))
    first = stored(first.where("first.doc < last").select("key", F.col("first.doc").alias("other"), F.col("first.begin").alias("place"), "often"))
    shared = held.join(first, "key").where("doc > other").select("doc", "row", F.struct("other", "begin", "end", "place", "often").alias("run"))
    gathered = shared.groupBy("doc", "row").agg(F.sort_array(F.collect_list("run")).alias("r"))  # the runs of one text
    gathered = gathered.select("doc", "row", *(F.col(f"r.{c}").alias(c) for c in ("other", "begin", "end", "place", "often")))

    def diffed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "row": b["row"], "spans": [blocks(*found) for found in zip(*(b[c] for c in ("other", "begin", "end", "place", "often")))]})

    return gathered.mapInPandas(diffed, "doc long, row long, spans array<struct<begin:int,end:int>>").where(F.size("spans") > 0)


def blocks(other: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, often: np.ndarray) -> list[dict]:
    """Deleted spans of a text, given its runs by the document that introduced them (ordered by it, then by place)."""
    starts = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
    pairs = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(other)])]
    gone: list[tuple[int, int]] = []
    for pair in sorted(pairs, key=lambda s: int(often[s].min())):
        own = place[pair].tolist()
        gone += [(int(begin[pair][i]), int(end[pair][i])) for i in aligned(own)]
    spans: list[dict] = []
    for a, b in sorted(gone):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"begin": a, "end": b})
    return spans


def kept_text(text: Column, spans: Column) -> Column:
    """The text without the spans; white space alone counts as nothing left. What is left of a line whose beginning went stays a line of its own."""
    raw, blank = text.cast("binary"), F.lit(BLANK.decode())
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    upto = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(raw)))

    def part(begin: Column, end: Column) -> Column:
        return F.decode(F.substring(raw, begin + 1, end - begin), "utf-8")

    def piece(a: Column, i: Column) -> Column:
        kept, span = part(a, F.get(upto, i)), F.get(spans, i - 1)
        bare = F.ltrim(kept, F.lit(BLANK.decode().replace("\n", "")))
        broken = (i > 0) & part(span["begin"], span["end"]).contains("\n") & (bare != "") & ~bare.startswith("\n")
        return F.when(broken, F.concat(F.lit("\n"), bare)).otherwise(kept)

    left = F.array_join(F.transform(ends, piece), "")
    left = F.when(F.get(spans, F.lit(0))["begin"] == 0, F.ltrim(left, blank)).otherwise(left)
    return F.when(spans.isNull(), text).when(F.trim(left, blank) == "", "").otherwise(left)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, Column]:
    """``docs`` (doc_id, text) with the kept text, and a column of it that holds the deleted spans (null: none).

    The frame has the columns of ``docs`` under their own names and that of the
    spans, whose name none of them has. Rows without doc_id or text stay as they
    are, empty tables give none.
    """
    spans = unused("spans", docs)
    gone = removals(docs, min_words).toDF("_doc", "_row", "_spans")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wide = docs.select("*", row_key()).toDF(*names, "_key")
    doc_id, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    held = wide.join(gone, (F.col(doc_id).cast("long") == F.col("_doc")) & (F.col("_key") == F.col("_row")), "left")
    held = held.withColumn(text, kept_text(F.col(text), F.col("_spans"))).select(*names, "_spans").toDF(*docs.columns, spans)
    return held, F.col(spans)
