import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from barloom.llm import pieces
from tests.llm.helpers import docs_frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "    a", "a    ", "\n", "\n\n a", "a\nb", "a \n b", "\t\tx", "▁", "a▁b ▁", "<s></s><unk><0x0A>", "</s>", "é", "é", "日本語 テスト 梦", "👩‍👩‍👧 ok", " x y", "\x00a\x01",
    "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "the the the", "ﬁ ſ Å", "﻿bom", "\U0010ffff", "a" * 31 + " " * 17 + "b",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def ours():
    return pieces.MergeVocabulary(MODEL)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_in_the_library(ours, library, text):
    ids = ours.encode(text)
    assert ids == [*library.encode(text), library.eos_id()]
    assert ours.decode(ids) == library.decode(ids)


def test_agenda_on_whole_texts_equals_segments_and_library(ours, library):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("  \n▁abcdetheinon.,éß日🙂") for _ in range(rng.randint(1, 80)))
        whole = ours.agenda_ids(pieces.SPACE + text.replace(" ", pieces.SPACE))
        assert whole == library.encode(text) == ours.encode(text)[:-1]
        escaped = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert ours.merged_short(escaped) == ours.merged_long(escaped)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 20)
    monkeypatch.setattr(pieces, "CHUNK", 50)
    small = pieces.MergeVocabulary(MODEL)
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(30)]
    assert [i.tolist() for i in small.encode_all(texts)] == library.encode(texts)
    assert [small.encode(t)[:-1] for t in texts] == library.encode(texts)
    assert len(small.fresh) + len(small.older) <= 120


def test_a_difference_is_an_error(ours):
    broken = pieces.MergeVocabulary(MODEL)
    broken.scores = {}
    with pytest.raises(pieces.Mismatch):
        broken.encode("internationalisation")


def test_digests_of_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pieces.digests(docs, MODEL).collect():
        ids = [*library.encode(text[r["doc_id"]]), library.eos_id()]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_columns_round_trip_and_edges(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (1, " "), (1, " ")]
    docs = docs_frame(spark, rows)
    done = docs.select("doc_id", "text", pieces.encoded(docs["text"], MODEL).alias("ids"))
    for r in done.withColumn("back", pieces.decoded(done["ids"], MODEL)).collect():
        assert r["ids"] == [*library.encode(r["text"] or ""), library.eos_id()]
        assert r["back"] == library.decode(r["ids"])
    assert pieces.digests(docs, MODEL).count() == len(rows)
    assert pieces.digests(docs_frame(spark, []), MODEL).count() == 0
    nothing = pieces.digests(docs_frame(spark, [(1, None)]), MODEL).first()
    assert nothing["n_tokens"] == 1 and nothing["ids_sha256"] == hashlib.sha256(b"2").hexdigest()


def test_no_piece_crosses_a_cut():
    """Segments end where no piece has such neighbours, so their ids in a row are those of the text."""
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert v.cuts_at_spaces and v.cuts_at_letters
    for text in ["don't, (stop) e.g. 3rd/x_y", "naïve café—déjà-vu ².½ x²y", "Ωmega αb漢字c д1", "  two  spaces\t\n\n a", "a\u0301b \u00a0c", "$$$%%% !!word!!"]:
        parts = v.segments(text)
        assert "".join(parts) == "▁" + text.replace(" ", "▁")
        assert v.encode(text) == [*v.library.encode(text), v.end]
