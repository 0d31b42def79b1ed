"""Near-duplicate embeddings by Euclidean p-stable hashing.

A unit vector's code in a table is floor((A x + b) / width) for `per_table` Gaussian projections; equal codes share
a bucket, and `tables` tables give chances to meet. At a cosine of 0.93 the distance is 0.374, so with a width of
2, 18 projections and 64 tables a link shares no bucket with probability 0.03, at 0.99 with 1e-9.

1. Equal vectors of a label become one node with a number of rows.
2. Each bucket tells its nodes of its smallest node. Nodes within half of the threshold's angle of such a node form
   a core: by the triangle inequality all nodes of a core are linked, so a group of copies, however large, is counted
   and not compared.
3. Buckets bring cores together, each core once for each bucket. Tasks compare their centers, in blocks where a bucket
   holds many, and keep the pairs of cores that the inequality leaves open.
4. Members of such pairs are compared by their exact cosine, block by block; tasks give each node's number of links,
   not the links. Components are those of the cores with a link.

Defined cases: rows whose label, vector or vec_id is null, and zero vectors, vectors with null or non-finite
components and empty ones, link with nothing and stay; vectors of different lengths don't link; rows with equal ids
are vectors of their own, as repeated rows are; ties don't arise; other columns are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .substring_dedup import _mix
from .vectors import binary, doubles, is_finite, lists, matrix

#: Angles are compared with this allowance, far above the rounding of arc cosines.
SLACK = 1e-6


def units(column: pa.Array) -> list[np.ndarray]:
    """Each row's vector at length 1; first divided by its largest component, so that no square overflows."""
    values, ends = lists(column)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        x = values[a:b] / np.abs(values[a:b]).max()
        out.append(x / np.sqrt(x @ x))
    return out


def table_keys(x: np.ndarray, width: float, per_table: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each row of x in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.normal(size=(x.shape[1], tables * per_table)), rng.uniform(0, width, tables * per_table)
    codes = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, per_table)
    keys = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), codes.shape[:2])
    for k in range(per_table):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + codes[:, :, k])
    return keys.view(np.int64)


def _nodes(rows: DataFrame, width: float, per_table: int, tables: int, seed: int) -> DataFrame:
    """node, label, dim, id (the smallest), m (rows), vector, unit and keys of each different vector of a label."""
    merged = rows.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # projections of a batch in memory
                batch = whole.slice(at, 1024)
                found = units(batch.column(1))
                dims = np.array([len(x) for x in found])
                keys = np.zeros((len(found), tables), np.int64)
                for d in np.unique(dims):
                    mine = np.flatnonzero(dims == d)
                    keys[mine] = table_keys(np.stack([found[i] for i in mine]), width, per_table, tables, seed)
                ends = pa.array(np.arange(0, tables * len(found) + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(dims, pa.int32()), pa.array([x.tobytes() for x in found], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                    names=["label", "vector", "id", "m", "dim", "unit", "keys"],
                )

    kind = dict(rows.dtypes)
    out = merged.mapInArrow(run, f"label {kind['label']}, vector array<double>, id long, m long, dim int, unit binary, keys array<long>")
    return stored(out.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def _angles(pairs: DataFrame) -> DataFrame:
    """node, top and the angle between x and y of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x.as_buffer()) for x in batch.column(2)])
            angle = np.zeros(batch.num_rows)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x, y = (matrix(batch.column(k).take(pa.array(mine))) for k in (2, 3))
                angle[mine] = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle)], names=["node", "top", "angle"])

    return pairs.select("node", "top", "x", "y").mapInArrow(run, "node long, top long, angle double")


def _near_cores(rows: DataFrame, most: float) -> DataFrame:
    """(a, b): cores of a bucket whose centers are no further apart than `most` and their reaches.

    rows: key columns, part, core, own (its block), reach, center; sorted by bucket. Buckets of one size are compared
    together, a bucket of many cores is cut in blocks before."""

    def near(core, own, reach, center) -> list[np.ndarray]:
        cos = np.einsum("gid,gjd->gij", center, center)
        cross = own.min(axis=1) != own.max(axis=1)  # a pair of different blocks: not those within one of them
        open_ = (np.arccos(np.clip(cos, -1, 1)) <= most + reach[:, :, None] + reach[:, None, :]) & (core[:, :, None] < core[:, None, :])
        open_ &= ~cross[:, None, None] | (own[:, :, None] != own[:, None, :])
        g, i, j = np.nonzero(open_)
        return [np.unique(np.stack([core[g, i], core[g, j]]), axis=1)]

    def flush(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket, core, own, reach = (table.column(k).to_numpy() for k in (0, 1, 2, 3))
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        end = len(bucket) if last else heads[-1]
        sizes = np.diff(np.r_[heads[heads < end], end])
        heads, found = heads[heads < end], []
        dims = np.array([len(x.as_buffer()) for x in table.column(4).take(pa.array(heads))]) if len(heads) else np.zeros(0)
        for size in np.unique(sizes[sizes > 1]):
            for d in np.unique(dims[sizes == size]):
                some = heads[(sizes == size) & (dims == d)]
                for at in range(0, len(some), max(1, (1 << 20) // (size * size))):
                    rows_ = some[at : at + max(1, (1 << 20) // (size * size)), None] + np.arange(size)
                    center = matrix(table.column(4).combine_chunks().take(pa.array(rows_.ravel())), np.float32).reshape(*rows_.shape, -1)
                    found += near(core[rows_], own[rows_], reach[rows_], center)
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        rest = table.slice(end).to_batches() if end < len(bucket) else []
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 14:
                out, held = flush(held, False)
                n = sum(b.num_rows for b in held)
                yield out
        if held:
            yield flush(held, True)[0]

    bucket = F.xxhash64("key", "label", "dim", "part")
    return rows.select(bucket.alias("bucket"), "core", "own", "reach", "center").mapInArrow(run, "a long, b long")


def _link_counts(pairs: DataFrame, least: float) -> DataFrame:
    """(node, own, other, n): rows of the core `other` that node, of the core `own`, is linked with; none, no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            for k in range(batch.num_rows):
                (na, ma, xa), (nb, mb, xb) = ((s.values.field(0).to_numpy(), s.values.field(1).to_numpy(), matrix(s.values.field(2))) for s in (batch.column(2)[k], batch.column(3)[k]))
                hit = xa @ xb.T >= least
                for node, own, other, n in ((na, a[k], b[k], hit @ mb), (nb, b[k], a[k], ma @ hit)):
                    some = np.flatnonzero(n)
                    for held, x in zip(out, (node[some], np.full(len(some), own), np.full(len(some), other), n[some])):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64()) for x in out], names=["node", "own", "other", "n"])

    return pairs.select("a", "b", "ba", "bb").mapInArrow(run, "node long, own long, other long, n long")


def embedding_duplicates(vectors: DataFrame, least: float = 0.93, width: float = 2.0, per_table: int = 18, tables: int = 64, seed: int = 11, block: int = 256) -> DataFrame:
    """vec_id, n_links, component_id and kept (the smallest id of its component) for each row of vectors
    (vec_id, embedding, label)."""
    limit = float(np.arccos(least))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", doubles("embedding").alias("vector"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite("vector") & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = vectors.where(good)
    nodes = _nodes(rows, width, per_table, tables, seed)

    members = nodes.select("node", "label", "dim", F.explode("keys").alias("key"))
    bucket = ["key", "label", "dim"]
    tops = stored(members.groupBy(*bucket).agg(F.min("node").alias("top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "vector-buckets")
    met = stored(members.join(tops, bucket), "vector-members")
    star = met.where("node <> top").select("node", "top").distinct()
    unit = nodes.select("node", "unit")
    star = star.join(unit.withColumnRenamed("unit", "x"), "node").join(unit.select(F.col("node").alias("top"), F.col("unit").alias("y")), "top")
    centers = _angles(star).where(F.col("angle") <= (limit - SLACK) / 2).groupBy("node").agg(F.min_by(F.struct(F.col("top").alias("core"), "angle"), "top").alias("c"))
    cores = nodes.select("node", "id", "m", "unit").join(centers, "node", "left")
    cores = stored(cores.select("node", "id", "m", "unit", F.coalesce("c.core", "node").alias("core"), F.coalesce("c.angle", F.lit(0.0)).alias("angle")), "vector-cores")
    whole = stored(cores.groupBy("core").agg(F.sum("m").alias("rows"), F.max("angle").alias("reach"), F.count(F.lit(1)).alias("size"), F.min("id").alias("id")), "core-sizes")

    # buckets of several cores, the cores with their centers
    in_buckets = stored(met.join(cores.select("node", "core"), "node").select(*bucket, "core").distinct(), "core-buckets")
    several = in_buckets.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*bucket, F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    centered = whole.select("core", "reach").join(unit.select(F.col("node").alias("core"), F.col("unit").alias("center")), "core")
    single = centered.mapInArrow(_to_single, "core long, reach double, center binary")
    at = F.pmod(F.xxhash64("core"), F.col("blocks")).cast("int")
    placed = in_buckets.join(several, bucket).withColumn("own", at).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("part", F.least("own", "_o") * F.col("blocks") + F.greatest("own", "_o")).drop("_o", "blocks").join(single, "core")
    dealt = placed.repartition(*bucket, "part").sortWithinPartitions(*bucket, "part")
    pairs = stored(_near_cores(dealt, limit + 1e-3).distinct(), "core-pairs")

    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int")
    blocks = cores.join(whole.select("core", "size"), "core").groupBy("core", cut.alias("cut")).agg(F.collect_list(F.struct("node", "m", "unit")).alias("block"))
    touched = pairs.select(F.explode(F.array("a", "b")).alias("core")).distinct()
    blocks = stored(blocks.join(touched, "core", "left_semi"), "core-blocks")
    both = pairs.join(blocks.select(F.col("core").alias("a"), F.col("block").alias("ba")), "a").join(blocks.select(F.col("core").alias("b"), F.col("block").alias("bb")), "b")
    cross = stored(_link_counts(both, least), "cross-links")

    joined = components(cross.select(F.col("own").alias("a"), F.col("other").alias("b")), "core-components")
    of_core = whole.join(joined, F.col("core") == F.col("node"), "left").select("core", "rows", "id", F.coalesce("component", "core").alias("component"))
    least_id = of_core.groupBy("component").agg(F.min("id").alias("component_id"))
    of_core = of_core.join(least_id, "component").select("core", "rows", "component_id")
    links = cross.groupBy("node").agg(F.sum("n").alias("n"))
    of_node = cores.select("node", "core").join(of_core, "core").join(links, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    found = nodes.select("node", "label", "vector").join(of_node, "node").drop("node")
    linked = rows.join(found, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _to_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centers in single precision, for what only sorts out."""
    for batch in batches:
        small = [np.frombuffer(x.as_buffer(), np.float64).astype(np.float32).tobytes() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(small, pa.binary())], names=["core", "reach", "center"])
