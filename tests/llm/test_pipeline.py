import hashlib

import duckdb
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import mixing
from barloom.llm.common import stored
from tests.llm import test_lines, test_shingles


def test_stages_do_their_whole_job(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf_dir)))
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    told, cut, alone, mix, tokens = (df.toPandas() for df in kept[1:])
    assert len(told) >= 0.99 * docs.count()
    texts = dict(zip(told["doc_id"], told["text"]))
    want = test_lines.plain_kept(texts)
    left = dict(zip(cut["doc_id"], cut["text"]))
    assert set(left) == {d for d in want if want[d] or not test_lines.split(texts[d])}
    assert {d: test_lines.split(t) for d, t in left.items()} == {d: want[d] for d in left}
    assert all(n == len(t) for n, t in zip(cut["n_chars"], cut["text"]))
    assert sorted(alone["doc_id"]) == test_shingles.plain_kept(left)
    con = duckdb.connect()
    con.register("documents", alone)
    copies = con.sql(f"select doc_id, taken // size as n from ({mixing.SQL}) where size > 0").fetchall()
    assert {d: n for d, n in copies if n} == mix[mix["text"].str.split().str.len() > 0].groupby("doc_id").size().to_dict()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = dict(zip(mix["doc_id"], mix["text"]))
    assert sorted(tokens["doc_id"]) == sorted(mix["doc_id"])
    for d, n, digest in zip(tokens["doc_id"], tokens["n_tokens"], tokens["ids_sha256"]):
        ids = [*library.encode(text[d]), 2]
        assert n == len(ids) and digest == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert docs.count() == 0


def test_stages_take_odd_rows_and_clashing_columns(spark):
    names = ["language", "_language", "_guess", "spans", "_spans", "_removed", "_doc", "_row", "_node", "node", "key", "_c0", "_head", "_copy", "place", "whole", "below", "ids", "size"]
    english = [f"the words and of this number {i} that were written by {i * 7} of them" for i in range(40)]
    texts = [(i, t, "en", "a") for i, t in enumerate(english)]
    texts += [(3, english[3], "en", "a"), (3, "the other text of the same id and of those words", "en", "b"), (None, "the text and the words without an id of that", "en", None)]
    texts += [(60, None, "en", "a"), (61, "", None, "b"), (62, "12 34", "en", None), (63, "the and of words " * 40_000, "en", "b"), (64, " ".join(english) + " and of the tail", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(*t, len(t[1] or ""), *names) for t in texts], schema)
    kept = [frame]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], None)))
        if name != "sentencepiece":
            assert kept[-1].columns == frame.columns
            assert all(r[n] == n for r in kept[-1].collect() for n in names)
    told, cut, alone = ({(r["doc_id"], r["text"]) for r in df.collect()} for df in kept[1:4])
    assert not {d for d, _ in told} & {60, 61, 62} and {(3, english[3]), (63, texts[-2][1])} <= told
    assert {d for d, _ in cut} >= {*range(40), 63, 64, None} and (3, texts[41][1]) in cut
    assert len([1 for d, _ in alone if d == 3]) == 2 and kept[3].where("doc_id = 3").count() == 2
    assert kept[5].count() == kept[4].count() > 0


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(entry.queries())
