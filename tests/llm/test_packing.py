"""Packing against the library's ids, a plain best-fit and the sequences rebuilt from the pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import packing, queries
from tests.llm.helpers import docs_frame

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def words():
    return packing.Words(FILE)


ODD = list("aAbBzZ019 \t\n\r\x0b\x0c\x1c\x1f\x00'sSrREe.,!?<|>éÉßÿÞ÷×µª²½İıΣσς漢字あ…“") + ["\u0301", "\u0331", "\u00a0", "\u2028", "\u200b", "\u0085", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'s", "'re", "H\u0331"]


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=4)), max_size=40))
def test_word_by_word_equals_the_library(words, library, parts):
    text = "".join(parts)
    assert np.frombuffer(words.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    cut = b"".join(words.ids(p.decode()) for p in packing.portions(text.encode(), 7))
    assert cut == words.ids(text)


def test_remembers_a_bounded_number():
    recent = packing.Recent(str, 10)
    assert [recent[i] for i in map(str, range(1000))] == list(map(str, range(1000)))
    assert len(recent) + len(recent.older) <= 20


def plain_bins(lengths, capacity, most):
    """Best fit by looking at every open bin; the fullest closes when ``most`` are open."""
    free, places, made = {}, [], 0
    for n in lengths:
        fits = [(f, b) for b, f in free.items() if f >= n]
        if fits:
            space = min(fits)[0]
            b = max(b for f, b in fits if f == space)
        else:
            if len(free) == most:
                least = min(free.values())
                del free[max(b for b, f in free.items() if f == least)]
            b, made = made, made + 1
            free[b] = capacity
        places.append((capacity - free[b], free[b] - n))
        free[b] -= n
        if not free[b]:
            del free[b]
    return places, made


@pytest.mark.parametrize("most", [1, 3, 50])
def test_bins_are_best_fit(most):
    rng = random.Random(most)
    for _ in range(60):
        lengths = [rng.randint(0, 20) for _ in range(120)]
        bins = packing.Bins(20, most)
        got, used = [], {}
        for n in lengths:
            b, offset = bins.put(n)
            assert offset == used.get(b, 0) and offset + n <= 20
            used[b] = offset + n
            assert sum(map(len, bins.free)) == bins.open <= most
            got.append((offset, 20 - offset - n))
        want, made = plain_bins(lengths, 20, most)
        assert got == want and bins.made == made


def check_pieces(docs, rows, library, capacity):
    """Every token of every document once, in order; sequences are gapless and never too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = [*library.encode(docs[d] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            assert r["start"] == r["piece"] * capacity and r["length"] == len(ids[r["start"] : r["start"] + capacity])
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + capacity], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_whole_table(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = queries.op11_best_fit_packing(spark, sf_dir)
    used, tokens = check_pieces(docs, df.collect(), library, packing.CAPACITY)
    assert used <= 1.02 * tokens / packing.CAPACITY + 8  # a part ends with one open sequence that is not full


def test_edges(spark, library):
    docs = {1: "", 2: None, 3: "one word " * 30_000, 4: "x" * 5000, 5: "<|endoftext|> a"}
    frame = docs_frame(spark, list(docs.items())).withColumnRenamed("size", "length")
    df = packing.packed(frame, FILE)
    check_pieces(docs, df.collect(), library, packing.CAPACITY)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    twice = packing.packed(docs_frame(spark, [(7, "a b"), (7, "a b"), (None, "a b"), (8, None)]), FILE).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in twice) == [("7", 3), ("7", 3), ("8", 1), ("None", 3)]
    assert packing.packed(docs_frame(spark, []), FILE).count() == 0


def test_sequences_hold_the_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    rows = packing.stored(packing.packed(docs, FILE, capacity=256, keep_ids=True))
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, found.values())) == sum(r["length"] for r in rows.collect())


def test_small_tasks_and_few_bins_lose_nothing(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    df = packing.stored(packing.pack(packing.stored(packing.token_pieces(docs, FILE, 512)), 512, 3))
    check_pieces({r["doc_id"]: r["text"] for r in docs.collect()}, df.collect(), library, 512)


def test_wrong_lengths_and_tokenizers_are_refused(spark):
    bad = spark.createDataFrame([(1, 9)], "doc_id long, length long")
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(bad, 8).collect()
    with pytest.raises(ValueError):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
