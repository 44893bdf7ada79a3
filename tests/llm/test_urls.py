from itertools import combinations

import pytest
from pyspark.sql import functions as F

from barloom.llm import urls

CASES = [
    ("https://a.org/x", "a.org", "/x", "org/"), ("HTTPS://WWW.Example.ORG/es/1?q", "www.example.org", "/es/1", "example.org/es/"), ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/"), ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/"), ("http://x.com/FR/", "x.com", "/FR/", None),
    ("http://com/de/1", "com", "/de/1", "com/de/"), ("http://a.org", "a.org", "", None), ("http://a.org?x=/y", "a.org", "", None), ("http://a.org#/es/", "a.org", "", None), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None),
    ("x://y://z/p", "y:", "//z/p", None), ("://h/p", "h", "/p", None), ("http://É.Org/ü", "É.org", "/ü", "org/"), ("http://a.net/de/\nb", "a.net", "/de/\nb", None), ("http:///path", "", "/path", None),
]


@pytest.mark.parametrize("url,host,path,rule", CASES)
def test_host_path_and_rule(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "u string").select(urls.host(F.col("u")).alias("h"), urls.path(F.col("u")).alias("p"))
    row = df.select("h", "p", urls.listed(F.col("h"), F.col("p"))["rule"].alias("r")).first()
    assert (row["h"], row["p"], row["r"]) == (host, path, rule)


def plain_rules(rows, support, confidence):
    """All token sets by counting, pruned as the operator prunes."""
    n, sets = len(rows), {}
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                sets.setdefault(c, {}).setdefault(verdict, 0)
                sets[c][verdict] += 1
    need = -(-n * support // 1)
    found = {(c, v): m / sum(by.values()) for c, by in sets.items() for v, m in by.items() if m >= need and m / sum(by.values()) >= confidence}
    return {(c, v): x for (c, v), x in found.items() if not any(len(d) < len(c) and set(d) < set(c) and found.get((d, v), -1) >= x for k in range(1, len(c)) for d in combinations(c, k))}


def test_mined_rules_match_counting(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    seen = pages.select("url", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p"))
    seen = seen.select(urls.tokens(F.col("url"), F.col("h"), F.col("p")).alias("tokens"), urls.listed(F.col("h"), F.col("p"))["verdict"].alias("verdict")).where("verdict is not null")
    rows = [(r["tokens"], r["verdict"]) for r in seen.collect()]
    want = plain_rules(rows, 0.08, 0.6)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in urls.mined(seen, 0.08, 0.6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 3
    out = urls.judged(pages, min_support=0.08, min_confidence=0.6).join(pages, "page_id")
    n = len(rows)
    size = {c: sum(set(c) <= set(t) and v == verdict for t, v in rows) / n for c, verdict in want}
    for r in out.select("*", urls.tokens(F.col("url"), F.col("host"), F.col("path")).alias("t")).collect():
        if r["rule"] is None:
            hits = [(x, size[c], len(c), " ".join(c), v) for (c, v), x in want.items() if set(c) <= set(r["t"])]
            assert r["verdict"] == (max(hits)[4] if hits else "allow")
        else:
            assert r["verdict"] == dict((x, v) for v, x in urls.RULES)[r["rule"]]


def test_every_row_is_judged_once(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(None, "http://b.org/1"), (0, "https://a.org/x"), (0, "https://a.org/x"), (50, "http://h.net/" + "x" * 50_000)]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    out = urls.judged(pages)
    assert out.count() == len(rows) and out.where("verdict not in ('allow', 'block') or verdict is null").count() == 0
    assert out.where("rule is not null and mined is not null").count() == 0
    assert urls.judged(pages.where("false")).count() == 0
    unlabelled = urls.judged(pages.where("url like '%net%'"))
    assert {r["verdict"] for r in unlabelled.collect()} == {"allow"}
