"""Line dedup: the patience diff, and the whole operator against all pairs of documents."""

import random
import re

import pytest

from barloom.llm import lines, queries
from tests.llm.helpers import docs_frame


def longest_rising(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_rising_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        pairs = [(i, rng.randint(0, 15)) for i in range(rng.randint(0, 25))]
        got = [pairs[k] for k in lines.rising(pairs)]
        assert len(got) == longest_rising(pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_alignment_prefers_unique_runs_and_rises():
    assert lines.alignment([3, 1, 2, 3]) == [1, 2, 3]  # the unique runs 1 and 2 decide where the repeated 3 may stand
    assert lines.alignment([5, 6, 0, 7]) == [0, 1, 3]
    rng = random.Random(2)
    for _ in range(300):
        own = [rng.randint(0, 12) for _ in range(rng.randint(0, 20))]
        got = lines.alignment(own)
        assert all(a < b and own[a] < own[b] for a, b in zip(got, got[1:])) and bool(got) == bool(own)
        assert lines.aligned(own) == list(range(len(own)))  # later diffs take what the first one leaves


def test_many_equal_lines_are_aligned_in_time():
    assert len(lines.aligned([3] * 200_000)) == 200_000
    assert len(lines.aligned(list(range(50_000)) * 2)) == 100_000


def split(text):
    """Sentences of the non-blank lines, by look-behind patterns."""
    cut = r"(?<=[.!?…])(?=[ \t]+\S)|(?<=[.!?…][\"')\]”’])(?=[ \t]+\S)|(?<=[。！？])(?=\S)"
    return [s.strip(" \t\r\v\f") for x in text.split("\n") if x.strip(" \t\r\v\f") for s in re.split(cut, x)]


def test_sentences_end_where_the_text_says():
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice(["a", "bé", " ", "  ", ".", "!", "?", "…", "\n", "\t", '"', ")", "。", "漢", "\r", " "]) for _ in range(rng.randint(0, 30)))
        found = list(lines.sentences(text))
        assert [s.decode() for s, _ in found] == [s for s in split(text) if s]
        assert all(text.encode()[:e].endswith(s) for s, e in found)


def common_runs(own, other, words, least):
    """Places of ``own`` in a run that is unbroken in ``other`` and holds ``least`` words, by all pairs of places."""
    out, at = set(), {}
    for j, x in enumerate(other):
        at.setdefault(x, []).append(j)
    for i in range(len(own)):
        for j in at.get(own[i], ()):
            n = 0
            while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                n += 1
            if sum(words[i : i + n]) >= least:
                out.update(range(i, i + n))
    return out


def plain_kept(docs, min_words=lines.MIN_WORDS):
    """Sentences left of every document when compared with all earlier ones."""
    units = {d: split(t or "") for d, t in docs.items()}
    out = {}
    for d, own in units.items():
        words = [len(x.split()) for x in own]
        gone = set().union(*(common_runs(own, units[e], words, min_words) for e in units if e < d))
        out[d] = [x for i, x in enumerate(own) if i not in gone]
    return out


def kept(frame):
    found, _ = lines.deduplicated(frame)
    return {r["doc_id"]: r["text"] for r in found.collect()}


def test_whole_table_matches_all_pairs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    want, got = plain_kept(docs), kept(df)
    assert {d: split(t or "") for d, t in got.items()} == want
    assert {d for d, t in got.items() if t == docs[d]} >= {d for d in want if want[d] == split(docs[d] or "")}
    rows = {r["doc_id"]: r for r in queries.op8_line_dedup(spark, sf_dir).collect()}
    assert all((rows[d]["n_removed"] > 0) == (t != docs[d]) and rows[d]["n_words"] == len((t or "").encode().split()) for d, t in got.items())


def test_random_documents_match_all_pairs(spark):
    rng = random.Random(8)
    pool = [f"line number {i} of the pool" for i in range(15)] + [f"w{i}" for i in range(6)] + ["two words", "now three words", ""]
    docs = {}
    for i in range(150):
        own = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {j}" for j in range(rng.randint(0, 20))]
        old = docs[rng.choice(list(docs))].split("\n") if docs else []
        at = rng.randint(0, len(old))
        docs[i] = "\n".join(own + old[at : at + rng.randint(0, 12)] + [f"end {i}"])
    got = kept(docs_frame(spark, list(docs.items())))
    want = plain_kept(docs)
    assert {d: split(t) for d, t in got.items()} == want and sum(want[d] != split(docs[d]) for d in docs) > 100


def test_without_alignment_nothing_goes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gathered = [([1, 1, 2], [0, 10, 20], [9, 19, 29], [0, 10, 0], [2, 2, 3])]
    whole = lines.alignment
    try:
        lines.alignment = lambda own: []
        import numpy as np

        assert [lines.blocks(*map(np.array, g)) for g in gathered] == [[]]
    finally:
        lines.alignment = whole
    assert [lines.blocks(*map(np.array, g)) for g in gathered] == [[{"begin": 0, "end": 9}, {"begin": 10, "end": 19}, {"begin": 20, "end": 29}]]
    assert lines.removals(df).count() > 20


def test_copy_of_repeated_lines_goes_whole(spark):
    song = "\n".join(["a chorus that comes back often", "first verse with several words here", "a chorus that comes back often", "x", "second verse with several words here", "a chorus that comes back often", "x"])
    framed = "its own title of the song\n" + song + "\nits own end of the song"
    assert kept(docs_frame(spark, [(1, song), (2, song), (3, framed)])) == {1: song, 2: "", 3: "its own title of the song\nits own end of the song"}


def test_passage_inside_a_line_goes(spark):
    passage = "It was said by all of them. Nobody knew who had said it first! Was it so?"
    docs = {1: passage, 2: f"An own beginning. {passage} An own end.\n\n  Its own line stays.", 3: f"Other words here.\n{passage} The end of it.", 4: f"{passage} Left."}
    got = kept(docs_frame(spark, list(docs.items())))
    assert got == {1: passage, 2: "An own beginning. An own end.\n\n  Its own line stays.", 3: "Other words here.\nThe end of it.", 4: "Left."}


def test_passage_without_spaces_goes(spark):
    passage = "これは 五つ の 語 を 持つ 文 です。"
    got = kept(docs_frame(spark, [(1, passage), (2, f"前の文\n{passage}後の文。")]))
    assert got == {1: passage, 2: "前の文\n後の文。"}


def test_rows_with_one_id_lose_nothing_of_their_own(spark):
    shared, own = "a common passage of six words.", "this unique sentence nobody else has."
    found, _ = lines.deduplicated(docs_frame(spark, [(1, shared), (2, shared), (2, own), (2, own), (3, own)]))
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == [(1, shared), (2, ""), (2, own), (2, own), (3, "")]


def test_edges(spark):
    long = "\n".join(f"a long document has line {i}" for i in range(5000))
    rows = [(1, long), (2, long + "\nits own last line here now"), (3, None), (4, ""), (5, "\n \n"), (None, long), (6, "a b"), (7, "a b"), (8, "ends with these five words"), (9, " ends with these five words\r"), (9, " ends with these five words\r")]
    found, _ = lines.deduplicated(docs_frame(spark, rows))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == [long] and got[2] == ["its own last line here now"] and got[None] == [long]
    assert got[3] == [None] and got[4] == [""] and got[5] == ["\n \n"] and got[6] == got[7] == ["a b"]
    assert got[8] == ["ends with these five words"] and got[9] == ["", ""]
    assert lines.deduplicated(docs_frame(spark, []))[0].count() == 0


@pytest.mark.parametrize("name", ["spans", "_removed", "_doc", "_row", "doc", "row", "key"])
def test_clashing_columns_stay(spark, name):
    frame = docs_frame(spark, [(1, "five words are in here"), (2, "five words are in here")]).withColumnRenamed("size", name)
    found, spans = lines.deduplicated(frame)
    assert found.columns[:-1] == frame.columns
    assert [(r["text"], r[name]) for r in found.where(spans.isNotNull()).collect()] == [("", "s")]


def test_hot_line_makes_no_pairs(spark):
    hot = [(i, f"the one line that all documents share\nown line {i} with several words in it") for i in range(3000)]
    assert lines.removals(docs_frame(spark, hot)).count() == 2999
