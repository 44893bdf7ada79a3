"""Decision memory: document text, last-write-wins store, cosine search for one probe and for many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.functions.numeric import fixed_text, pct_text, ratio
from barloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------
DOC_CHARS = 200
EMPTY_NOTICE = "No previous trading history in vector memory."
HEADER = "Recent similar decisions (RAG):"
# ----------------------------------------------------------------------------
SAMPLE_ROWS, REGION_ROWS, MOST_REGIONS = 8_192, 4_096, 1_024
PROBE_ROWS, PROBE_BLOCK = 16_384, 512  # probes that a task gets with a chunk, and compares at once
SLACK = 1e-6  # of an angle, for rounding


def decision_documents(weights: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, doc, style, pnl_pct, weights_json) from (run_date, symbol, weight) and per-run facts.

    ``runs`` is (run_date, style, rationale, pnl_pct). A run holds a bounded
    number of names, listed by size.
    """
    entry = F.struct((-F.col("weight")).alias("o"), "symbol", "weight")
    lists = weights.groupBy("run_date").agg(F.array_sort(F.collect_list(entry)).alias("w"))
    held = F.transform(F.filter("w", lambda x: x["weight"] > 0), lambda x: F.concat(x["symbol"], F.lit("="), pct_text(x["weight"], 1)))
    as_map = F.map_from_entries(F.transform("w", lambda x: F.struct(x["symbol"], x["weight"])))
    day = F.date_format("run_date", "yyyy-MM-dd")
    return runs.join(lists, "run_date").select(
        day.alias("id"),
        F.concat(
            F.lit("Date: "), day, F.lit(". Style: "), F.col("style"), F.lit(". Positions: "), F.array_join(held, ", "), F.lit(". Rationale: "), F.col("rationale")
        ).alias("doc"),
        "style",
        F.coalesce("pnl_pct", F.lit(0.0)).alias("pnl_pct"),
        F.to_json(as_map).alias("weights_json"),
    )


def upsert(store: DataFrame, updates: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Latest version per key; a partial aggregate, so hot keys collapse before the shuffle."""
    rows = store.unionByName(updates)
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("r")).select(key, "r.*")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - ratio(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))


def similar_decisions(store: DataFrame, probe: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest stored decisions to the one embedding in ``probe``; exact.

    The probe enters as a scalar, the store is scanned once and each task keeps
    its own k best before the final merge.
    """
    with_probe = store.withColumn("_probe", probe.select("embedding").scalar())
    scored = with_probe.withColumn("distance", cosine_distance(F.col("embedding"), F.col("_probe"))).drop("embedding", "_probe")
    return scored.where(F.col("distance").isNotNull()).orderBy("distance", "id").limit(k)


def similar_decisions_lsh(store: DataFrame, probe_vector, k: int = 5, tables: int = 8, width: float = 0.5) -> DataFrame:
    """Approximate variant: locality-sensitive hashing on unit vectors, for very large stores."""
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
    unit = store.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x / norm)))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=42).fit(unit)
    near = model.approxNearestNeighbors(unit, probe_vector, k, distCol="l2")
    return near.select("id", (F.col("l2") * F.col("l2") / 2).alias("distance"))


@dataclass(frozen=True)
class Regions:
    """Pivots of a store as unit vectors, and the least and largest angle between each and its rows (NaN: it has none)."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    chunks: np.ndarray


def _units(rows: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) of a column of arrays."""
    x = np.array([np.asarray(r, float) for r in rows])
    norm = np.sqrt((x * x).sum(1))
    return x / norm[:, None], norm


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(id, embedding) of the rows that have a cosine with others: no missing component, not all zero."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.select("id", x.alias("embedding")).where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False)))


def far_apart(x: np.ndarray, wanted: int) -> np.ndarray:
    """Pivots by farthest-first choice, from the row nearest to the mean on."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = angles(x, x[chosen])[:, 0]
    while len(chosen) < wanted and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def pivot_store(store: DataFrame) -> tuple[DataFrame, Regions]:
    """((region, chunk, id, embedding), regions): every usable row of ``store`` (id, embedding) with its nearest pivot.

    Pivots come from a hash sample of SAMPLE_ROWS rows, one for about REGION_ROWS
    rows of the store; they only decide how much is read, never what is found. A
    region that is larger is dealt into chunks, so that no task holds more. The driver gets
    the sample and two angles per pivot. All vectors have one length.
    """
    rows = cut_lineage(usable_vectors(store))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return rows.select(F.lit(0).alias("region"), F.lit(0).alias("chunk"), "id", "embedding"), Regions(np.empty((0, 0)), *(np.empty(0),) * 3)
    pivots = far_apart(_units(sample)[0], min(MOST_REGIONS, -(-total // REGION_ROWS)))

    @pandas_udf("region int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        a = angles(_units(vectors)[0], pivots)
        at = a.argmin(1)
        return pd.DataFrame({"region": at.astype(np.int32), "angle": a[np.arange(len(a)), at]})

    placed = cut_lineage(rows.withColumn("_p", nearest("embedding")).select("id", "embedding", "_p.region", "_p.angle"))
    sizes = placed.groupBy("region").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).toPandas().set_index("region")
    sizes = sizes.reindex(range(len(pivots)))
    chunks = np.maximum(1, -(-sizes["n"].fillna(0).to_numpy() // REGION_ROWS)).astype(int)
    deal = F.array(*[F.lit(int(c)) for c in chunks])
    chunk = F.pmod(F.xxhash64("id"), F.get(deal, F.col("region"))).cast("int")
    return placed.select("region", chunk.alias("chunk"), "id", "embedding"), Regions(pivots, sizes["low"].to_numpy(), sizes["high"].to_numpy(), chunks)


def _nearest_in(probes: DataFrame, placed: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """(probe, id, distance): the k nearest rows of each chunk for the probes (probe, vector, region, chunk) sent to it.

    The probes of a chunk are dealt into ``parts`` and compared PROBE_BLOCK at a
    time, so that a task holds neither all probes nor a matrix of all distances.
    """

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"probe": [], "id": [], "distance": []})
        rows = rows.sort_values("id", kind="stable")
        x, ids = np.array(rows["embedding"].tolist(), float), rows["id"].to_numpy()
        squares, found = (x * x).sum(1), []
        for start in range(0, len(asked), PROBE_BLOCK):
            block = asked.iloc[start : start + PROBE_BLOCK]
            q = np.array(block["vector"].tolist(), float)
            d = 1.0 - (q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * squares[None, :])
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"probe": np.repeat(block["probe"].to_numpy(), at.shape[1]), "id": ids[at].ravel(), "distance": np.take_along_axis(d, at, 1).ravel()}))
        return pd.concat(found, ignore_index=True)

    schema = f"probe {placed.schema['id'].dataType.simpleString()}, id {placed.schema['id'].dataType.simpleString()}, distance double"
    keys = ["region", "chunk"]
    if parts > 1:
        keys = [*keys, "part"]
        probes = probes.withColumn("part", F.pmod(F.xxhash64("probe"), F.lit(parts)).cast("int"))
        placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return probes.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(search, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_batch(placed: DataFrame, regions: Regions, probes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """((probe, id, distance, rank), (probe, regions_read, regions)): the k nearest rows for every row of ``probes`` (id, embedding); exact.

    A probe first visits the region of its nearest pivot. The angle of the k-th row
    found there bounds the search: a region is read only if the triangle inequality
    lets it hold something as near. With fewer than k rows so far, all are read.
    """
    asked = usable_vectors(probes).select(F.col("id").alias("probe"), F.col("embedding").alias("vector"))
    if not len(regions.pivots):
        none = asked.where(F.lit(False)).select("probe", F.col("probe").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return none, asked.select("probe", F.lit(0).alias("regions_read"), F.lit(0).alias("regions"))
    filled = np.flatnonzero(~np.isnan(regions.low))

    @pandas_udf("array<int>")
    def routes(vectors: pd.Series, bound: pd.Series) -> pd.Series:
        """Without a bound, the home region; with one, all others that may hold a row within it."""
        a = angles(_units(vectors)[0], regions.pivots[filled])
        home = a.argmin(1)
        least = np.maximum(np.maximum(a - regions.high[filled], regions.low[filled] - a), 0.0)
        out = []
        for i, b in enumerate(bound.to_numpy(float)):
            open_ = np.flatnonzero(least[i] <= b + SLACK) if not np.isnan(b) else home[i : i + 1]
            out.append(filled[open_ if np.isnan(b) else open_[open_ != home[i]]].tolist())
        return pd.Series(out)

    deal = F.array(*[F.lit(int(c)) for c in regions.chunks])
    parts = max(1, -(-asked.count() // PROBE_ROWS))

    def sent(rows: DataFrame) -> DataFrame:
        to = rows.withColumn("region", F.explode(routes("vector", "bound")))
        return to.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(deal, F.col("region")) - 1))).select("probe", "vector", "region", "chunk")

    first = cut_lineage(_best(_nearest_in(sent(asked.withColumn("bound", F.lit(None).cast("double"))), placed, k, parts), k))
    worst = first.groupBy("probe").agg(F.max("distance").alias("d"), F.count("*").alias("n"))
    angle = F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - F.col("d"))))).otherwise(F.lit(4.0))
    bounded = asked.join(worst, "probe", "left").select("probe", "vector", F.coalesce(angle, F.lit(4.0)).alias("bound"))
    more = cut_lineage(sent(bounded))
    found = _best(first.drop("rank").unionByName(_nearest_in(more, placed, k, parts)), k)
    read = more.select("probe", "region").distinct().groupBy("probe").agg(F.count("*").alias("_more"))
    reads = asked.join(read, "probe", "left").select("probe", (F.coalesce("_more", F.lit(0)) + 1).cast("int").alias("regions_read"), F.lit(len(filled)).alias("regions"))
    return found, reads


def memory_lines(hits: DataFrame) -> DataFrame:
    """(id, line): a header without id, then a text line per retrieved decision; without any, the notice alone.

    ``hits`` has id, style, pnl_pct and doc.
    """
    pnl = F.when(F.coalesce("pnl_pct", F.lit(0.0)) != 0, F.concat(F.lit(" | PnL: "), fixed_text("pnl_pct", 2, sign=True), F.lit("%"))).otherwise("")
    lines = hits.select(
        "id", F.concat(F.lit("  ["), F.col("id").cast("string"), F.lit("] "), F.upper("style"), pnl, F.lit(": "), F.substring("doc", 1, DOC_CHARS)).alias("line")
    )
    kind = hits.schema["id"].dataType
    head = hits.agg(F.count("*").alias("n")).select(F.lit(None).cast(kind).alias("id"), F.when(F.col("n") == 0, EMPTY_NOTICE).otherwise(HEADER).alias("line"))
    return lines.unionByName(head)
