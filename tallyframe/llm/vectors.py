"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are made one first, with their number. Centroids are fitted on a bounded
sample; every vector has a home cell and visits each cell whose border is within REACH of
it (distance to the plane between the two centroids), as a link may cross it. Inside a
cell, home vectors in blocks are multiplied with each other and with the visitors, in double
precision; a pair that two cells could find counts in the lower one. A block pair
returns sums by vector and a spanning forest of its links, never all pairs.

Defined cases: a vector that is null, empty, zero or has null or non-finite components
links with nothing, as does one with a null id; vectors of other lengths do not link;
repeated rows are vectors of their own and link with each other. Extra columns pass through,
`n_links`, `component_id` and `kept` replace columns of these names.

A link between vectors whose difference lies nearly all across a border may be missed:
at cosine 0.9 a difference is 0.447 long, and REACH bounds its part across. The tests
measure recall against brute force. REACH = 0.436 misses nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, written

COSINE = 0.9
REACH = 0.13
SAMPLE = 16_384  # vectors that the centroids are fitted on, at most
CELL = 2_000  # vectors of a cell to aim at
MAX_CELLS = 512
BLOCK = 1_024  # rows of one product


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def units(column: pa.Array) -> list[bytes | None]:
    """Each usable vector at length 1, as bytes of doubles."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        ok = None
        if v and all(x is not None for x in v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top
                ok = (x / np.sqrt(x @ x)).tobytes()
        out.append(ok)
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable over links (i, j), for each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE,
                    reach: float = REACH, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Adds n_links, component_id and kept to all rows."""
    spark = vectors.sparkSession
    vectors = vectors.drop("n_links", "component_id", "kept")

    def prepare(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units(batch.column(1)), pa.binary())], names=["id", "unit"])

    ids = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column))
    rows = written(ids.mapInArrow(prepare, "id long, unit binary").where("id is not null and unit is not null"), "units")
    # equal vectors become one, whatever their number
    distinct = written(rows.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct")
    n = distinct.count()
    k = max(1, min(MAX_CELLS, -(-n // cell)))
    draw = distinct if n <= SAMPLE else distinct.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * SAMPLE / n))
    size = draw.groupBy(F.length("unit").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return vectors.select("*", F.lit(0).cast("long").alias("n_links"), F.col(id_column).cast("long").alias("component_id"),
                              F.lit(True).alias("kept"))
    size = size["size"]
    sample = [np.frombuffer(r["unit"]) for r in draw.where(F.length("unit") == size).orderBy("id").collect()]
    centroids = spark.sparkContext.broadcast(kmeans(np.array(sample), min(k, len(sample))))  # MAX_CELLS rows at most

    def assign(batches):
        c = centroids.value
        apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
        for batch in batches:
            found = [[], [], [], []]
            for i, (u, at) in enumerate(zip(batch.column(1).to_pylist(), range(batch.num_rows))):
                x = np.frombuffer(u)
                if len(x) != c.shape[1]:
                    # other lengths: a cell for each, below 0
                    home, visits = -len(x), []
                else:
                    sims = c @ x
                    home = int(sims.argmax())
                    near = np.flatnonzero(sims[home] - sims <= reach * apart[home])
                    visits = near[near != home].tolist()
                for cell_id in (home, *visits):
                    found[0].append(at)
                    found[1].append(cell_id)
                    found[2].append(home)
                    found[3].append(visits if cell_id == home else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(found[0])), batch.column(1).take(pa.array(found[0])), batch.column(2).take(pa.array(found[0])),
                 pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.list_(pa.int32()))],
                names=["id", "unit", "copies", "cell", "home", "visits"])

    placed = written(distinct.select("id", "unit", "copies").mapInArrow(
        assign, "id long, unit binary, copies long, cell int, home int, visits array<int>"), "placed")
    # blocks of each cell: home blocks 0.., each against itself, later ones and the visitors' blocks
    counts = placed.groupBy("cell").agg(
        F.ceil(F.sum((F.col("cell") == F.col("home")).cast("int")) / block).alias("homes"),
        F.ceil(F.sum((F.col("cell") != F.col("home")).cast("int")) / block).alias("guests"))  # a row for each cell
    at_home = F.col("cell") == F.col("home")
    own = F.pmod(F.xxhash64("id"), F.when(at_home, F.greatest("homes", F.lit(1))).otherwise(F.col("guests")))
    pairs = F.expr("""CASE WHEN cell = home THEN concat(
            transform(sequence(0, cast(homes as int) - 1), x -> struct(least(x, own) AS left, greatest(x, own) AS right, false AS guest)),
            IF(guests > 0, transform(sequence(0, cast(guests as int) - 1), x -> struct(own AS left, x AS right, true AS guest)),
               array()))
        WHEN homes > 0 THEN transform(sequence(0, cast(homes as int) - 1), x -> struct(x AS left, own AS right, true AS guest))
        ELSE array() END""")
    tasks = (placed.join(F.broadcast(counts), "cell").withColumn("own", own.cast("int"))
             .withColumn("pair", F.explode(pairs))
             .select("cell", "pair.*", "id", "unit", "copies", "home", "visits", "own"))

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cell_id, left, right, guest = key
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        ids, copies, home = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["home"].to_numpy()
        here, own = home == cell_id, pdf["own"].to_numpy()
        a = np.flatnonzero(here & (own == left)) if guest or left != right else np.arange(len(pdf))
        b = np.flatnonzero(~here) if guest else np.flatnonzero(own == right)
        found = []
        for s in range(0, len(a), BLOCK):
            for t in range(0, len(b), BLOCK):
                i, j = np.nonzero(x[a[s:s + BLOCK]] @ x[b[t:t + BLOCK]].T >= cosine)
                i, j = a[s + i], b[t + j]
                if not guest and left == right:
                    i, j = i[i < j], j[i < j]
                if guest and len(i):
                    # the pair counts in the lower cell where both are in each other's home
                    visits = pdf["visits"].to_numpy()
                    twice = np.fromiter((home[q] < cell_id and home[q] in visits[p] for p, q in zip(i, j)), bool, len(i))
                    i, j = i[~twice], j[~twice]
                found.append((i, j))
        i = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        j = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = _forest(len(ids), i, j) if len(i) else np.arange(len(ids))
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"id": ids[some], "root": ids[root[some]], "n": links[some].astype(np.int64)})

    found = written(tasks.groupBy("cell", "left", "right", "guest").applyInPandas(compare, "id long, root long, n long"), "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    each = (distinct.join(sums, "id", "left").join(groups, "id", "left")
            .select("unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))
    by_id = rows.join(each, "unit").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.withColumn("_id", F.col(id_column).cast("long")).join(by_id.withColumnRenamed("id", "_id"), "_id", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(*vectors.columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
