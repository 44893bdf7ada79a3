"""SentencePiece encoding by an agenda of symbol pairs, checked against the library, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"  # how the vocabulary writes a space
CACHED = 350_000  # segments that a worker remembers, twice
JOINED = 100  # segments that are checked as one text
CHUNK = 1 << 20  # characters encoded at a time
SHORT = 48  # symbols up to which a list is the faster agenda
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NEVER = float("inf")  # score of a pair that is no piece


class Mismatch(ValueError):
    """The agenda and the library disagree."""


class MergeVocabulary:
    """Encoder for a merge-type (BPE) model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, dummy prefix and identity normalisation")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.library.eos_id()
        self.names = [str(i) for i in range(len(model.pieces))]
        # no merge crosses a place before a space, nor one beside a character that no longer piece holds
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids if len(p) > 1))
        self.alone = alone
        # nor one between a Latin letter and another mark, if no piece has such neighbours
        mixed = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN}{SPACE}][{LATIN}]")
        self.cuts_at_letters = not any(mixed.search(p) for p in self.ids)
        if not self.cuts_at_spaces:
            pattern = "(?s:.+)"
        elif self.cuts_at_letters:
            pattern = f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        else:
            pattern = f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")
        self.segment = re.compile(pattern)
        self.fresh: dict[str, bytes] = {}  # ids of segments, packed
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Symbols after all merges: the best-scored adjacent pair first, the leftmost of equals."""
        return self.merged_short(text) if len(text) <= SHORT else self.merged_long(text)

    def merged_short(self, text: str) -> list[str]:
        """Few symbols: the agenda is the list of the pairs' scores by place, searched for its least."""
        score = self.scores.get
        symbols = list(text)
        agenda = [score(a + b, NEVER) for a, b in zip(symbols, text[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            whole = symbols[i] + symbols[i + 1]
            symbols[i] = whole
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = score(whole + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + whole, NEVER)
        return symbols

    def merged_long(self, text: str) -> list[str]:
        """Many symbols: the agenda is a heap, and pairs that a merge has broken up are passed over."""
        scores = self.scores
        symbols: list[str] = list(text)
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda = []
        for i in range(last):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((score, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has been merged since
            whole = left + right
            symbols[i], symbols[j] = whole, ""
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                score = scores.get(whole + symbols[k])
                if score is not None:
                    heapq.heappush(agenda, (score, i, k, len(whole) + len(symbols[k])))
            h = before[i]
            if h >= 0:
                score = scores.get(symbols[h] + whole)
                if score is not None:
                    heapq.heappush(agenda, (score, h, i, len(symbols[h]) + len(whole)))
        return [s for s in symbols if s]

    def agenda_ids(self, text: str) -> list[int]:
        """Ids of an escaped text, byte by byte where a symbol is not in the vocabulary."""
        symbols = self.merged(text)
        out = list(map(self.ids.get, symbols))
        if None in out:
            out = list(chain.from_iterable((i,) if i is not None else [self.bytes[b] for b in s.encode()] for i, s in zip(out, symbols)))
        return out

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, segments: set[str]) -> None:
        """Encode segments by the agenda, check them all against the library, and remember them."""
        kept = {s: self.older[s] for s in segments if s in self.older}
        found = {s: self.agenda_ids(s) for s in segments if s not in kept}
        self.check(found)
        if len(self.fresh) + len(segments) > CACHED:
            self.older, self.fresh = self.fresh, {}
        self.fresh.update(kept)
        self.fresh.update((s, array("I", ids).tobytes()) for s, ids in found.items())

    def check(self, found: dict[str, list[int]]) -> None:
        """Hold the ids of segments against what the library gives for texts made of many segments each."""
        lead = self.library.encode("\n")  # the space before every text, and the line break
        asked: list[tuple[str, list[int]]] = []
        joined: list[tuple[str, list[int]]] = []
        for s, ids in found.items():
            if s.strip(SPACE) == "":  # would merge with the next one's space
                asked.append(("\n" + s.replace(SPACE, " "), lead + ids))
            else:
                joined.append((s.replace(SPACE, " "), ids) if s[0] == SPACE else ("\n" + s, lead[1:] + ids))
        for i in range(0, len(joined), JOINED):
            part = joined[i : i + JOINED]
            asked.append(("\n" + "".join(t for t, _ in part), lead + list(chain.from_iterable(i for _, i in part))))
        for (text, ids), want in zip(asked, self.library.encode([t for t, _ in asked], num_threads=1)):
            if ids != want:
                raise Mismatch(f"{text!r}: agenda {ids}, library {want}")

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of every text, without the end id; texts go in chunks, so that few segments are held at once."""
        chunk, size = [], 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self.encode_chunk(chunk)
                chunk, size = [], 0
        yield from self.encode_chunk(chunk)

    def encode_chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts = [self.segments(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        packed = list(map(self.fresh.get, flat))
        missing = {s for s, p in zip(flat, packed) if p is None}
        if missing:
            self.learn(missing)
            packed = [self.fresh[s] if p is None else p for s, p in zip(flat, packed)]
        at = 0
        for part in parts:
            yield np.frombuffer(b"".join(packed[at : at + len(part)]), np.uint32)
            at += len(part)

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with the end id."""
        (ids,) = self.encode_chunk([text])
        return [*ids.tolist(), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the library."""
        return self.library.decode(ids)


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> MergeVocabulary:
    """One encoder per worker and model."""
    return MergeVocabulary(model_file)


def encoded(text: Column, model_file: str) -> Column:
    """Ids of every text (null: empty), with the end id: array<int>."""

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        v = vocabulary(model_file)
        return pd.Series([[*ids.tolist(), v.end] for ids in v.encode_all(t or "" for t in texts)])

    return ids(text)


def decoded(ids: Column, model_file: str) -> Column:
    """The text of an array of ids; null ids give an empty text."""

    @pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        v = vocabulary(model_file)
        return pd.Series([v.decode(list(map(int, r))) if r is not None else "" for r in rows])

    return text(ids)


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs`` (doc_id, text).

    Ids end with the end id; ``ids_sha256`` is the digest of the decimal ids joined
    by one space, ``decoded_sha256`` that of the text the library decodes from
    them. A null text counts as empty (the end id alone). Whole texts are encoded;
    a text needs memory for itself and its ids. Nothing is shuffled.
    """

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(model_file)
        out = []
        for packed in v.encode_all(t or "" for t in texts):
            ids = [*packed.tolist(), v.end]
            names = " ".join(map(v.names.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")
