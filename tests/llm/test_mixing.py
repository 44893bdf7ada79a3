import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing
from tests.llm.helpers import docs_frame

ROWS = [
    *[(i, "w " * (i % 50), None, "a") for i in range(400)],
    *[(1000 + i, "w " * 10, None, "b") for i in range(30)],
    (2000, "x " * 5000, None, "c"),
    *[(3000 + i, "one two", None, None) for i in range(20)],
    (4000, None, None, "d"), (4001, "", None, "d"), (None, "null id here", None, "a"), (7, "w " * 7, None, "a"), (7, "w " * 7, None, "a"),
]


def by_sql(pdf):
    con = duckdb.connect()
    con.register("documents", pdf)
    return con.sql(mixing.SQL).df()


@pytest.mark.parametrize("bits", [12, 4])
def test_mix_equals_sql_on_hard_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "LEVEL_BITS", bits)  # few bits a level: the budget's bucket is split several times
    docs = docs_frame(spark, ROWS)
    got = mixing.mix(docs).toPandas()
    pdf = docs.select("doc_id", "text", "source").toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    want = by_sql(pdf)
    # repeated ids multiply in the SQL join, so rows are compared once each
    key = ["doc_id", "size", "source_size", "target", "taken"]
    plain = lambda d: set(map(tuple, d[key].astype({"doc_id": "Int64"}).astype(str).values))
    assert plain(got) == plain(want) and len(got) == len(ROWS)


def test_targets_are_met_and_capped(spark):
    docs = docs_frame(spark, ROWS)
    rows = mixing.mix(docs).join(docs.select("doc_id", F.coalesce("source", F.lit("-")).alias("src")).distinct(), "doc_id").toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    for src, part in rows.groupby("src"):
        total, target = part["source_size"].iloc[0], part["target"].iloc[0]
        assert target <= 2 * total
        assert abs(part["taken"].sum() - target) <= part["size"].max() + 7 * 14  # a document, or the repeated one
    goals = mixing.targets(mixing.sized(docs)).toPandas()
    assert abs(goals["target"].sum() - 1.5 * goals["source_size"].sum()) < 1e-6


def test_reruns_agree_whatever_the_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(5, "text")).collect()))


def test_thresholds_of_growing_budgets_are_nested(spark):
    sizes = mixing.sized(docs_frame(spark, ROWS))
    below = []
    for share in (0.2, 0.5, 0.9):
        goals = mixing.targets(sizes, share=share)
        below.append({r["source"]: (r["whole"], r["below"]) for r in mixing.thresholds(sizes, goals).collect()})
    for src in below[0]:
        assert below[0][src] <= below[1][src] <= below[2][src]


def test_mixed_rows_are_the_copies_taken(spark):
    docs = docs_frame(spark, ROWS)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = out.select(F.coalesce(F.col("source"), F.lit("-")).alias("s"), mixing.size_of(F.col("text")).alias("n")).groupBy("s").sum("n")
    got = {r[0]: r[1] for r in words.collect()}
    goals = {r["source"] or "-": r["target"] for r in mixing.targets(mixing.sized(docs)).collect()}
    for s, n in got.items():
        assert n == pytest.approx(goals[s], abs=5000 if s == "c" else 150)


def test_empty_table(spark):
    empty = docs_frame(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_size_counts_words_of_the_contract(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc\x0cd\re\n",), ("  x",)], "t string")
    assert [r[0] for r in df.select(mixing.size_of(F.col("t"))).collect()] == [0, 0, 5, 2]
