"""Model evaluation, model fits, decision memory."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranking import average_rank, positional_split
from barloom.operators import evaluation as ev
from barloom.operators import memory, modeling
from barloom.plans.cte import cte, pyround
from barloom.plans.portfolios import constrained
from barloom.plans.registry import query
from barloom.plans.signals import full_panel
from barloom.session import keep
from barloom.sources.tables import BARS_ASOF, Tables

# the settings of the research process, all rounds of them
TRAIN, WALK = modeling.Boosting(), modeling.Boosting(rounds=300, step=0.05)

# -- splits and profile -----------------------------------------------------------


@query(
    "w27_positional_split",
    "SELECT date, symbol, row_number() OVER (ORDER BY date, symbol) <= floor((SELECT count(*) FROM scored_panel)*0.8::DOUBLE) AS is_train FROM scored_panel",
    "scored_panel",
)
def _(t: Tables) -> DataFrame:
    return positional_split(t.scored_panel()).select("date", "symbol", "is_train")


@query(
    "a14_profile",
    "SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(date) AS min_date, max(date) AS max_date, avg(label) AS pos_rate, (max(date)-min(date))/365.25::DOUBLE AS years FROM scored_panel",
    "scored_panel",
    "pos_rate years",
)
def _(t: Tables) -> DataFrame:
    return ev.profile(t.scored_panel())


cte(
    "splits",
    """SELECT year(s) || '-' || year(e) AS split, s AS test_start, e AS test_end, n_train, n_test FROM (
       SELECT s, e, (SELECT count(*) FROM scored_panel p WHERE p.date < s) AS n_train, (SELECT count(*) FROM scored_panel p WHERE p.date >= s AND p.date < e) AS n_test FROM (
       SELECT CAST(lo + INTERVAL (24 + 12*k) MONTH AS DATE) AS s, CAST(lo + INTERVAL (36 + 12*k) MONTH AS DATE) AS e, hi FROM (SELECT min(date) AS lo, max(date) AS hi FROM scored_panel), range(0, 50) r(k))
       WHERE e <= hi) WHERE n_train >= 200 AND n_test >= 50""",
    "scored_panel",
)
cte("split_rows", "SELECT s.split, p.* FROM scored_panel p JOIN splits s ON p.date >= s.test_start AND p.date < s.test_end", "splits", "scored_panel")


@query("d26_walk_forward_splits", "SELECT * FROM splits", "splits")
def _(t: Tables) -> DataFrame:
    return ev.walk_forward_splits(t.scored_panel())


def split_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    panel = keep(t.scored_panel())
    splits = ev.walk_forward_splits(panel)
    return ev.tag_splits(panel, splits), splits


@query("d26_tag_splits", "SELECT split, date, symbol, proba FROM split_rows", "split_rows")
def _(t: Tables) -> DataFrame:
    return split_rows(t)[0].select("split", "date", "symbol", "proba")


# -- metrics --------------------------------------------------------------------------


def _ranked(src: str, part: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    both = ", ".join(x for x in (part, "{c}") if x)
    rank = f"rank() OVER ({over}ORDER BY {{c}}) + (count(*) OVER (PARTITION BY {both}) - 1)/2.0::DOUBLE"
    return f"SELECT *, {rank.format(c='proba')} AS rp, {rank.format(c='fwd_ret')} AS rf FROM {src} WHERE fwd_ret IS NOT NULL"


cte("ranked", _ranked("scored_panel", ""), "scored_panel")
cte("split_ranked", _ranked("split_rows", "split"), "split_rows")
_AUC = """SELECT {k} (sum(r) FILTER (label=1) - sum(label)*(sum(label)+1)/2)/(sum(label)*(count(*)-sum(label))) AS auc FROM (
  SELECT {k} label, rank() OVER ({p} ORDER BY proba) + (count(*) OVER (PARTITION BY {k} proba) - 1)/2.0::DOUBLE AS r FROM {src}) {g}"""


@query(
    "a11_average_rank",
    "SELECT fwd_ret, count(*) AS n, avg(rf) AS rank FROM ranked GROUP BY 1",
    "ranked",
    "rank",
)
def _(t: Tables) -> DataFrame:
    return average_rank(keep(t.scored_panel()), "fwd_ret")


@query("a10_accuracy", "SELECT avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM scored_panel", "scored_panel", "acc")
def _(t: Tables) -> DataFrame:
    return ev.accuracy(t.scored_panel())


@query("a10_roc_auc", _AUC.format(k="", p="", src="scored_panel", g=""), "scored_panel", "auc")
def _(t: Tables) -> DataFrame:
    return ev.roc_auc(keep(t.scored_panel()))


@query("a11_rank_ic", "SELECT covar_pop(rp, rf)/(stddev_pop(rp)*stddev_pop(rf)) AS ic FROM ranked", "ranked", "ic")
def _(t: Tables) -> DataFrame:
    return ev.rank_ic(keep(t.scored_panel()))


cte("top5", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY proba DESC, symbol) AS rank FROM scored_panel) WHERE rank <= 5", "scored_panel")


@query("w25_top_per_date", "SELECT date, symbol, CAST(rank AS INTEGER) AS rank, label FROM top5", "top5")
def _(t: Tables) -> DataFrame:
    return ev.top_per_date(t.scored_panel()).select("date", "symbol", "rank", "label")


@query("a12_precision_at_top", "SELECT avg(p) AS p_at_k FROM (SELECT avg(label) AS p FROM top5 GROUP BY date HAVING count(*) >= 2)", "top5", "p_at_k")
def _(t: Tables) -> DataFrame:
    return ev.precision_at_top(t.scored_panel())


cte(
    "bt_day",
    "SELECT date, avg(fwd_ret) AS r FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY proba DESC, symbol) AS rank FROM scored_panel WHERE fwd_ret IS NOT NULL) WHERE rank <= 5 GROUP BY 1",
    "scored_panel",
)
cte(
    "bt_market",
    "SELECT arg_max(close, date)/arg_min(close, date) - 1 AS m FROM market WHERE date >= (SELECT min(date) FROM scored_panel) AND date < (SELECT max(date) FROM scored_panel)",
    "market",
    "scored_panel",
)


@query(
    "d25_a09_topk_backtest",
    "SELECT n_days, log_strategy, benchmark FROM (SELECT count(*) AS n_days, sum(CASE WHEN 1 + r/5 > 0 THEN ln(1 + r/5) END) AS log_strategy, (SELECT m FROM bt_market) AS benchmark FROM bt_day)",
    "bt_day bt_market",
    "log_strategy:6 benchmark",
)
def _(t: Tables) -> DataFrame:
    return ev.topk_backtest(t.scored_panel(), t.market()).select("n_days", "log_strategy", "benchmark")


cte("split_auc", _AUC.format(k="split,", p="PARTITION BY split", src="split_rows", g="GROUP BY split"), "split_rows")
cte("split_ic", "SELECT split, CASE WHEN count(*) > 10 THEN covar_pop(rp, rf)/(stddev_pop(rp)*stddev_pop(rf)) ELSE 0 END AS ic FROM split_ranked GROUP BY 1", "split_ranked")
cte(
    "split_metrics",
    f"SELECT split, {pyround('auc', 4)} AS auc, {pyround('ic', 4)} AS ic, n_train, n_test FROM (SELECT a.split, auc, ic, n_train, n_test FROM split_auc a JOIN split_ic USING (split) JOIN splits USING (split))",
    "split_auc",
    "split_ic",
    "splits",
)


@query("a22_split_metrics", "SELECT * FROM split_metrics", "split_metrics", "auc ic")
def _(t: Tables) -> DataFrame:
    rows, splits = split_rows(t)
    return ev.split_metrics(keep(rows), splits)


@query(
    "a08_split_summary",
    """SELECT *, CASE WHEN mean_auc >= 0.51 AND mean_ic > 0 THEN 'PASS' WHEN mean_ic > 0 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM (
       SELECT avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, min(auc) AS min_auc, max(auc) AS max_auc, avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, min(ic) AS min_ic, max(ic) AS max_ic,
              count(*) FILTER (ic > 0) AS positive_ic, count(*) AS n_splits FROM split_metrics)""",
    "split_metrics",
    "mean_auc std_auc min_auc max_auc mean_ic std_ic min_ic max_ic",
)
def _(t: Tables) -> DataFrame:
    rows, splits = split_rows(t)
    return ev.summarise_splits(ev.split_metrics(keep(rows), splits))


@query(
    "d24_quality_gate",
    f"""SELECT {pyround('auc', 4)} AS auc, {pyround('ic', 4)} AS ic, {pyround('acc', 4)} AS acc, auc >= 0.5 AND ic >= 0 AS usable FROM (
        SELECT (SELECT auc FROM ({_AUC.format(k="", p="", src="scored_panel", g="")})) AS auc, (SELECT covar_pop(rp, rf)/(stddev_pop(rp)*stddev_pop(rf)) FROM ranked) AS ic,
               (SELECT avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM scored_panel) AS acc)""",
    "scored_panel ranked",
    "auc ic acc",
)
def _(t: Tables) -> DataFrame:
    p = keep(t.scored_panel())
    return ev.quality_gate(ev.accuracy(p), ev.roc_auc(p), ev.rank_ic(p))


# -- model fits (no SQL twin; pinned by tests) ---------------------------------------------


@query("d24_train_eval")
def _(t: Tables) -> DataFrame:
    return modeling.train_eval(full_panel(t), TRAIN)[2]


@query("d26_walk_forward")
def _(t: Tables) -> DataFrame:
    return modeling.walk_forward(full_panel(t), WALK)[0]


@query("d27_train_final")
def _(t: Tables) -> DataFrame:
    panel = full_panel(t)
    _, summary, model = modeling.walk_forward_run(panel, WALK, TRAIN)
    return modeling.run_record(panel, summary, model)


@query("a21_importances")
def _(t: Tables) -> DataFrame:
    return modeling.importances(modeling.train_eval(full_panel(t), TRAIN)[0])


# -- decision memory ------------------------------------------------------------------------

cte(
    "cosine",
    """SELECT e.vec_id AS id, 1.0::DOUBLE - list_dot_product(e.v, q.v)/sqrt(list_dot_product(e.v, e.v)*list_dot_product(q.v, q.v)) AS distance FROM
       (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) q""",
)


@query("j14_similar_decisions", "SELECT id, round(distance, 8) AS distance FROM (SELECT * FROM cosine ORDER BY distance, id LIMIT 20)", "cosine", "distance")
def _(t: Tables) -> DataFrame:
    store = t.decisions()
    return memory.similar_decisions(store, store.where("id = 0"), 20).select("id", "distance")


cte("vectors", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")


@query(
    "j14_similar_batch",
    """SELECT probe, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS rank FROM (
        SELECT q.id AS probe, e.id, 1.0::DOUBLE - list_dot_product(e.v, q.v)/sqrt(list_dot_product(e.v, e.v)*list_dot_product(q.v, q.v)) AS distance FROM vectors q, vectors e WHERE q.id % 10 = 3)) WHERE rank <= 5""",
    "vectors",
    "distance",
)
def _(t: Tables) -> DataFrame:
    placed, regions = memory.pivot_store(t.decisions())
    return memory.similar_batch(placed, regions, t.decisions().where("id % 10 = 3"), 5)[0]


@query("j14_similar_lsh", "SELECT count(*) = 5 AS all_found, bool_and(distance < 2) AS near FROM (SELECT * FROM cosine ORDER BY distance, id LIMIT 5)", "cosine")
def _(t: Tables) -> DataFrame:
    """The approximate search finds as many, and nothing but rows of the store."""
    probe = t.decisions().where("id = 0").select("embedding").first()["embedding"]
    norm = sum(x * x for x in probe) ** 0.5
    found = memory.similar_decisions_lsh(t.decisions(), Vectors.dense([x / norm for x in probe]), 5)
    return found.agg((F.count("*") == 5).alias("all_found"), F.coalesce(F.every(F.col("distance") < 2), F.lit(False)).alias("near"))


@query(
    "d41_memory_lines",
    """SELECT id, '  [' || id || '] ' || upper(['aggressive','balanced','conservative'][id % 3 + 1]) || CASE WHEN label <> 4 THEN ' | PnL: ' || printf('%+.2f', (label-4)/4.0::DOUBLE) || '%' ELSE '' END || ': ' || 'decision ' || id AS line
       FROM cosine JOIN embeddings e ON e.vec_id = id WHERE id IN (SELECT id FROM cosine ORDER BY distance, id LIMIT 20)
       UNION ALL SELECT NULL, 'Recent similar decisions (RAG):'""",
    "cosine",
)
def _(t: Tables) -> DataFrame:
    store = t.decisions().withColumn("doc", F.concat(F.lit("decision "), F.col("id")))
    return memory.memory_lines(memory.similar_decisions(store, store.where("id = 0"), 20))


@query(
    "u07_upsert",
    "SELECT user_id AS id, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value", "event_type")
    old, new = rows.where("event_type in ('view', 'click')"), rows.where("event_type not in ('view', 'click')")
    return memory.upsert(old.drop("event_type"), new.drop("event_type"))


@query(
    "d41_decision_documents",
    """SELECT strftime(run_date, '%Y-%m-%d') AS id, 'Date: ' || strftime(run_date, '%Y-%m-%d') || '. Style: balanced. Positions: ' || string_agg(symbol || '=' || printf('%.1f', weight*100) || '%', ', ' ORDER BY weight DESC, symbol) || '. Rationale: daily' AS doc,
       'balanced' AS style, 0.0::DOUBLE AS pnl_pct FROM (SELECT run_date, symbol, round(weight, 3) AS weight FROM constrained) WHERE weight > 0 GROUP BY run_date""",
    "constrained",
)
def _(t: Tables) -> DataFrame:
    w = constrained(t).select("run_date", "symbol", F.round("weight", 3).alias("weight"))
    runs = t.raw("events").select(F.col("ts").cast("date").alias("run_date")).distinct()
    facts = runs.select("run_date", F.lit("balanced").alias("style"), F.lit("daily").alias("rationale"), F.lit(None).cast("double").alias("pnl_pct"))
    return memory.decision_documents(w, facts).drop("weights_json")
