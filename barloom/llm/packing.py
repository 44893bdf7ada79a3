"""Best-fit packing of token sequences: bounded-space online best-fit with the open bins in a bitset keyed by free space.

Documents are tokenized in Arrow batches and only lengths and digests (with
``keep_ids`` the ids too) are written out. The packer then reads these narrow rows; a
task packs what it reads, in order, and a place is final once it is given, so
nothing but the open bins stays in memory and a task that is run again gives the
same places.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

CAPACITY, END = 2_048, 0
OPEN_BINS = 4_096
MEMORY = 200_000  # tokens of a text whose ids a worker remembers, twice
TEXTS = 1 << 22  # bytes of text tokenized at a time
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"  # lower-case letters of the plain path; with A-Z, the upper-case ones and ASCII they make a plain text
PLAIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
NORMALIZERS = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Words:
    """Token ids of texts as little-endian unsigned 32-bit numbers, equal to the library's for the whole text.

    For a lower-casing byte-level BPE that drops white space, a text of ASCII and
    Latin-1 letters is cut by the tokenizer's own pattern, and each cut is merged by the library's
    model once and remembered. Other texts are cut at ASCII white space, which no
    token crosses, and their other words are given to the library as they are.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        spec = json.loads(self.library.to_str())
        steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != NORMALIZERS or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or (cuts[0]["behavior"], cuts[0]["invert"]) != ("Removed", True) or cuts[1]["add_prefix_space"]:
            raise ValueError("only lower-casing byte-level tokenizers that drop white space are packed word by word")
        pattern = cuts[0]["pattern"]["Regex"]
        for name, chars in ((r"\p{L}", LETTERS), (r"\p{N}", "0-9"), (r"\s", "\t-\r ")):
            pattern = pattern.replace(name, chars)
        self.cut = re.compile(pattern).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_letters()
        self.plain, self.other = Recent(self.merged, MEMORY), Recent(self.fresh, MEMORY // 8)

    def merged(self, token: str) -> bytes:
        return np.asarray([t.id for t in self.library.model.tokenize("".join([self.letters[b] for b in token.encode()]))], "<u4").tobytes()

    def fresh(self, word: str) -> bytes:
        return np.asarray(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        special = "<" in text and any(s in text for s in self.special)
        if not special and PLAIN.fullmatch(text):
            return b"".join(map(self.plain.__getitem__, self.cut(text.lower())))
        out = []
        for word in text.encode().split():
            word = word.decode()
            if PLAIN.fullmatch(word) and not (special and any(s in word for s in self.special)):
                out += map(self.plain.__getitem__, self.cut(word.lower()))
            else:
                out.append(self.other[word])
        return b"".join(out)


class Recent(dict):
    """Computes a value when first asked and remembers the values asked for of late: between ``cap`` and twice as many."""

    def __init__(self, make, cap: int):
        super().__init__()
        self.make, self.cap, self.older = make, cap, {}

    def __missing__(self, key):
        if len(self) >= self.cap:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


def portions(text: bytes, most: int = TEXTS) -> Iterator[bytes]:
    """Parts of a text, cut at ASCII white space where it is longer than ``most`` bytes."""
    a = 0
    while len(text) - a > most:
        at = max(text.rfind(s, a, a + most) for s in (b" ", b"\n", b"\t"))
        if at <= a:
            at = min((p for p in (text.find(s, a + most) for s in (b" ", b"\n", b"\t")) if p >= 0), default=len(text))
        yield text[a:at]
        a = at
    yield text[a:]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of ``docs`` (doc_id, text): ids and an end id, cut where they pass ``capacity``.

    A null text counts as empty and is one piece with the end id alone; a row
    without doc_id gives pieces without doc_id; repeated rows give theirs each.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = Words(tokenizer_file), np.asarray([END], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].array, b["text"]):
                ids = b"".join([*(words.ids(t.decode()) for t in portions(text)), end])
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row = (doc, k, k * capacity, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int64).tolist()) if keep_ids else row)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return wide.mapInPandas(cut, schema)


class Bins:
    """At most ``most`` open bins; bit f of ``bits`` is set while a bin with f free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.open, self.made = capacity, most, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for ``length`` places: the fullest open bin that has them, or a new one."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            held = self.free[space]
            bin_ = held.pop()
            if not held:
                self.bits ^= 1 << space
        else:
            if self.open == self.most:  # the fullest closes
                least = (self.bits & -self.bits).bit_length() - 1
                self.free[least].pop()
                if not self.free[least]:
                    self.bits ^= 1 << least
                self.open -= 1
            bin_, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return bin_, self.capacity - space


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """The columns of ``pieces`` (length, ...) with ``sequence_id`` and ``offset``: gapless places from 0 in sequences of ``capacity``.

    Within an Arrow batch the longest pieces come first. A task packs what it reads
    into sequences of its own (the ids differ by task), so ``pieces`` should be a
    written table, as ``packed`` passes it: its parts are read in one order
    whenever a task is repeated. Lengths are from 0 to ``capacity``; a null length is refused.
    """
    names = pieces.columns

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            if b["length"].isna().any() or not b["length"].between(0, capacity).all():
                raise ValueError(f"lengths must be from 0 to {capacity}")
            lengths = b["length"].to_numpy(np.int64)
            order = np.argsort(-lengths, kind="stable")
            at = np.empty((len(b), 2), np.int64)
            at[order] = [bins.put(n) for n in lengths[order].tolist()] or np.empty((0, 2), np.int64)
            b["sequence_id"], b["offset"] = at[:, 0] + first, at[:, 1]
            yield b[[*names, "sequence_id", "offset"]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id long, offset long"])
    return pieces.mapInPandas(placed, schema)


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece of ``docs`` (doc_id, text).

    Every document but one longer than ``capacity`` stays whole. Nulls, empty texts
    and repeated rows as in ``token_pieces``; an empty table gives none; other
    columns are not looked at. ``sequence_id`` depends on how many parts are read.
    """
    return pack(stored(token_pieces(docs, tokenizer_file, capacity, keep_ids)), capacity, open_bins)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of ``placed`` (sequence_id, offset, ids): the training sequences themselves; a group holds one sequence."""
    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return held.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
