"""Hard negatives by one-dimensional distance keys.

Components become the integers floor(scale * x), scores integer inner products. A row of squared length s gets one
more component, sqrt(M - s) with M the largest s; then the squared distance to a query with 0 there is |q|^2 + M - 2 score,
so the best scores are the nearest rows.

1. Pivots are the centers of a bounded sample of rows; each row is stored in blocks sorted by (nearest pivot,
   distance to it). A block is an annulus around its pivot; a small table tells its pivot and its key interval.
2. A query can find nothing within a radius r in an annulus whose keys are all further than r from its own distance
   to the pivot. So a round scans, for groups of queries, the annuli that their radii reach and that no round
   scanned for them before; a query is done when its radius covers its last result (or all it may find), and
   else its radius grows: up to that bound, or until it takes in `growth` times as many rows.
3. Positives come first: the best rows of an anchor's label. Their scores are windows, and a second search takes the
   best rows of other labels in each window; annuli that lie wholly nearer than all windows are left out.

Scores are exact: products run in doubles while they stay below 2^53, else in 64-bit integers.

The number of pairs of query groups and blocks is the work, as each query meets every row in the worst case; blocks
(`block_rows`) and groups (`group_rows`) bound what a task holds. The sample has `sample` rows.

Defined cases: rows with a null vec_id, label or vector, with null or non-finite components, or of a length of 2^31
and more after scaling take no part; shorter vectors end in zeros; rows of one id are rows of their own, but none is
another row for an anchor of the same id, and each is an anchor; ties go to the smaller id; an anchor without
positives, or a positive without negatives in its window, has no rows; other columns are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import doubles, is_finite, lists

NONE = np.iinfo(np.int64).min


def _scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, x (int32 components as binary) and sq; rows that are too long are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = lists(batch.column(3))
            values = np.floor(values * scale)
            keep, cells, squares = [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                with np.errstate(over="ignore"):
                    sq = float(values[a:b] @ values[a:b])
                if sq < 2.0**62:
                    x = values[a:b].astype(np.int64)
                    keep.append(i)
                    cells.append(x.astype(np.int32).tobytes())
                    squares.append(int(x @ x))
            mine = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*mine.columns[:3], pa.array(cells, pa.binary()), pa.array(squares, pa.int64())], names=["vec_id", "label", "anchor", "x", "sq"])

    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, anchor boolean, x binary, sq long")


def _padded(cells, dim: int) -> np.ndarray:
    out = np.zeros((len(cells), dim), np.int32)
    for i, c in enumerate(cells):
        x = np.frombuffer(c.as_buffer() or b"", np.int32)
        out[i, : len(x)] = x
    return out


class Space:
    """The augmented space with its pivots; small, and sent with each task."""

    def __init__(self, dim: int, most: int, pivots: np.ndarray):
        self.dim, self.most, self.pivots = dim, most, pivots
        self.slack = 1e-9 * (1 + most**0.5)

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """To each pivot; last: the component that was added."""
        out = np.empty((len(x), len(self.pivots)))
        for k, p in enumerate(self.pivots):
            out[:, k] = np.sqrt(((x - p[:-1]) ** 2).sum(axis=1) + (last - p[-1]) ** 2)
        return out

    def added(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(float(self.most) - squares, 0.0))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x, np.zeros(len(x)))

    def radius(self, squares: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has this score."""
        return np.sqrt(np.maximum(squares + float(self.most) - 2.0 * score, 0.0))


def centers(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centers of the sample x by Lloyd's rounds from its first different rows on."""
    found = np.unique(x, axis=0)
    found = found[np.linspace(0, len(found) - 1, min(k, len(found))).astype(int)]
    for _ in range(rounds):
        near = np.argmin((found**2).sum(axis=1) - 2 * x @ found.T, axis=1)
        for j in range(len(found)):
            if (near == j).any():
                found[j] = x[near == j].mean(axis=0)
    return found


def _blocks(rows: DataFrame, space: Space, most_rows: int, queries: bool, name: str) -> DataFrame:
    """block, pivot, lo, hi, n, ids, labels and x: runs of rows in the order of (nearest pivot, distance to it)."""
    kind = dict(rows.dtypes)["label"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column(2), space.dim)
            d = space.queries(x) if queries else space.distances(x, space.added(batch.column(3).to_numpy()))
            pivot = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot]), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["pivot", "key", "vec_id", "label", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)

        def block(held: pa.Table) -> pa.RecordBatch:
            held = held.combine_chunks()
            keys, n = held.column("key").to_numpy(), held.num_rows
            ends = pa.array([0, n], pa.int32())
            one = lambda c: pa.ListArray.from_arrays(ends, held.column(c).combine_chunks())
            x = b"".join(c.as_buffer().to_pybytes() for c in held.column("x"))
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)], pa.int64()), held.column("pivot").combine_chunks().slice(0, 1), pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([n], pa.int32()), one("vec_id"), one("label"), pa.array([x], pa.binary())],
                names=["block", "pivot", "lo", "hi", "n", "ids", "labels", "x"],
            )

        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            pivots = held.column("pivot").to_numpy()
            starts = [0]
            for edge in [*np.flatnonzero(np.diff(pivots)) + 1, len(pivots)]:
                while edge - starts[-1] > most_rows:
                    starts.append(starts[-1] + most_rows)
                if not queries or edge == len(pivots):  # a group of queries may lie around several pivots
                    starts.append(edge)
            for a, b in zip(starts[:-2], starts[1:-1]):
                yield block(held.slice(a, b - a))
            held = held.slice(starts[-2])
        if held is not None and held.num_rows:
            yield block(held)

    keyed = rows.select("vec_id", "label", "x", "sq").mapInArrow(near, f"pivot int, key double, vec_id long, label {kind}, x binary")
    order = ["pivot", "key", "vec_id"]
    out = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"block long, pivot int, lo double, hi double, n int, ids array<long>, labels array<{kind}>, x binary")
    return stored(out, name)


def _best(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best open scores of each row, equal ones by column."""
    s = np.where(open_, scores, NONE)
    if s.shape[1] > k:
        kth = -np.partition(-s.clip(NONE + 1), k - 1, axis=1)[:, k - 1 : k]
        open_ = open_ & (s >= kth)
    i, j = np.nonzero(open_)
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b (int32 components, lengths below 2^31)."""
    long_ = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for x in (a, b)]
    if long_[0] * long_[1] < 2.0**52:  # bounds every partial sum of products
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _scan(work: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """(grp, at, slot, score, vec_id): what each query of a group finds best in a block, for each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r in range(batch.num_rows):
                grp, pivot, lo, hi = (batch.column(c)[r].as_py() for c in ("grp", "pivot", "lo", "hi"))
                ids, labels = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                qids, qlabels, seen, reach = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("qids", "qlabels", "seen", "reach"))
                x, q = (np.frombuffer(batch.column(c)[r].as_buffer() or b"", np.int32).reshape(-1, space.dim) if space.dim else np.zeros((n, 0), np.int32) for c, n in (("x", len(ids)), ("qx", len(qids))))
                d = space.queries(q)[:, pivot]
                away = np.maximum(np.maximum(lo - d, d - hi), 0)
                todo = np.flatnonzero((away <= reach) & (away > seen))
                if not len(todo):
                    continue
                order = np.argsort(ids, kind="stable")
                ids, labels, x = ids[order], labels[order], x[order]
                scores = products(q[todo], x)
                alike = qlabels[todo, None] == labels
                open_ = alike & (qids[todo, None] != ids) if same else ~alike
                least, most = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64).reshape(len(qids), -1)[todo] for c in ("least", "most"))
                for slot in range(least.shape[1]):
                    i, j = _best(scores, open_ & (scores >= least[:, slot : slot + 1]) & (scores <= most[:, slot : slot + 1]), k)
                    for held, v in zip(out, (np.full(len(i), grp), todo[i], np.full(len(i), slot), scores[i, j], ids[j])):
                        held.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, kinds)], names=["grp", "at", "slot", "score", "vec_id"])

    return work.mapInArrow(run, "grp long, at int, slot int, score long, vec_id long")


class Steps:
    """Rows by pivot and key interval, at most 64 intervals each, to choose radii from."""

    def __init__(self, annuli: DataFrame, space: Space):
        wide = annuli.agg(F.max("hi")).first()[0] / 64 or 1.0
        step = F.floor(F.col("lo") / wide).alias("_step")
        found = annuli.groupBy("pivot", step).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
        self.pivot, self.lo, self.hi, self.n = (np.array([r[c] for r in found]) for c in ("pivot", "lo", "hi", "n"))

    def radius(self, d: np.ndarray, inner: np.ndarray, rows: float) -> np.ndarray:
        """For each query (d: its distances to pivots) the radius that takes in about `rows` rows that aren't all
        nearer than `inner`; inf where there are fewer."""
        mine = d[:, self.pivot]
        away = np.maximum(np.maximum(self.lo - mine, mine - self.hi), 0)
        count = np.where(mine + self.hi >= inner[:, None], self.n, 0)
        order = np.argsort(away, axis=1, kind="stable")
        total = np.take_along_axis(count, order, 1).cumsum(axis=1)
        at = (total < rows).sum(axis=1)
        sorted_ = np.take_along_axis(away, order, 1)
        return np.where(at < away.shape[1], sorted_[np.arange(len(d)), np.minimum(at, away.shape[1] - 1)], np.inf)


QUERY = "grp long, qids array<long>, qlabels array<{kind}>, qx binary, seen array<double>, reach array<double>, least binary, most binary"


def _search(queries: DataFrame, annuli: DataFrame, space: Space, same: bool, k: int, first_rows: int, growth: int, kind: str) -> DataFrame:
    """(grp, at, slot, rank, score, vec_id): the k best rows of each window of each query.

    queries: as QUERY, with seen and reach empty before the first round; a window is empty where least > most."""
    steps = Steps(annuli, space)
    directory = annuli.select("block", "pivot", "lo", "hi")
    schema = QUERY.format(kind=kind)

    def grown(rows: float):
        """Radii of the next round, from the k-th scores found; a radius of -1: done."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    n = len(batch.column("qids")[r])
                    q = np.frombuffer(batch.column("qx")[r].as_buffer() or b"", np.int32).reshape(n, space.dim)
                    squares = (q.astype(np.float64) ** 2).sum(axis=1)
                    least, most = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64).reshape(n, -1) for c in ("least", "most"))
                    reach = batch.column("reach")[r].values.to_numpy()
                    seen = reach if len(reach) else np.full(n, -1.0)
                    bound = least.copy()
                    for got in batch.column("kth")[r].as_py() or []:
                        bound[got["at"], got["slot"]] = max(got["score"], bound[got["at"], got["slot"]])
                    real = least <= most
                    need = np.where(real, np.where(bound == NONE, np.inf, space.radius(squares[:, None], np.where(bound == NONE, 0, bound))), -1.0).max(axis=1)
                    need = np.where(need >= 0, need * (1 + 1e-9) + space.slack, -1.0)
                    inner = np.where(real, np.where(most == -NONE - 1, 0.0, space.radius(squares[:, None], np.where(most == -NONE - 1, 0, most))), np.inf).min(axis=1)
                    inner = np.where(np.isfinite(inner), inner * (1 - 1e-9) - space.slack, 0.0)
                    step = np.maximum(steps.radius(space.queries(q), inner, rows) + space.slack, inner)
                    now = np.where(need > seen, np.minimum(need, step), -1.0)
                    now = np.where((now >= 0) & (now <= seen), np.minimum(need, np.inf), now)
                    # a query that is done keeps what it has seen as its radius, with nothing new in it
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(r, 1) for c in ("grp", "qids", "qlabels", "qx")), pa.array([seen], pa.list_(pa.float64())), pa.array([np.where(now >= 0, now, seen)], pa.list_(pa.float64())), *(batch.column(c).slice(r, 1) for c in ("least", "most"))],
                        names=["grp", "qids", "qlabels", "qx", "seen", "reach", "least", "most"],
                    )

        return run

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pivot the keys that a group's open queries reach, those that all of them have seen, and the
        keys below which all lies nearer than their windows."""
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in range(batch.num_rows):
                seen, reach = (batch.column(c)[r].values.to_numpy() for c in ("seen", "reach"))
                todo = np.flatnonzero(reach > seen)
                if not len(todo):
                    continue
                n = len(seen)
                q = np.frombuffer(batch.column("qx")[r].as_buffer() or b"", np.int32).reshape(n, space.dim)[todo]
                least, most = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64).reshape(n, -1)[todo] for c in ("least", "most"))
                squares, d = (q.astype(np.float64) ** 2).sum(axis=1), space.queries(q)
                inner = np.where(least <= most, np.where(most == -NONE - 1, 0.0, space.radius(squares[:, None], np.where(most == -NONE - 1, 0, most))), np.inf).min(axis=1)
                inner = inner * (1 - 1e-9) - space.slack
                s, e = seen[todo, None], reach[todo, None]
                edges = [(d - e).min(axis=0), (d + e).max(axis=0), np.where(s < 0, np.inf, d - s).max(axis=0), np.where(s < 0, -np.inf, d + s).min(axis=0), (inner[:, None] - d).min(axis=0)]
                for held, v in zip(out, [np.full(d.shape[1], batch.column("grp")[r].as_py()), np.arange(d.shape[1]), *edges]):
                    held.append(v)
            kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, kinds)], names=["grp", "p", "from", "to", "seen_from", "seen_to", "above"])

    best, rows, queries = None, first_rows, stored(queries.withColumn("kth", F.lit(None).cast("array<struct<at:int,slot:int,score:bigint>>")), "queries")
    salts = 1 + directory.count() // (1000 * len(space.pivots))
    directory = directory.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    while True:
        asked = stored(queries.mapInArrow(grown(rows), schema), "radii")
        if asked.where("exists(arrays_zip(seen, reach), z -> z.reach > z.seen)").isEmpty():
            break
        reached = asked.mapInArrow(intervals, "grp long, p int, `from` double, `to` double, seen_from double, seen_to double, above double")
        reached = reached.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = reached.join(directory, (F.col("p") == F.col("pivot")) & (reached["_salt"] == directory["_salt"]) & (F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to")) & ~((F.col("hi") >= F.col("seen_from")) & (F.col("lo") <= F.col("seen_to"))) & (F.col("hi") >= F.col("above")))
        work = met.select("grp", "block").join(asked, "grp").join(annuli, "block")
        found = _scan(work, space, same, k)
        if best is not None:
            found = found.unionByName(best.select(found.columns))
        order = Window.partitionBy("grp", "at", "slot").orderBy(F.desc("score"), "vec_id")
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        kth = best.where(F.col("rank") == k).groupBy("grp").agg(F.collect_list(F.struct("at", "slot", "score")).alias("kth"))
        queries = asked.join(kth, "grp", "left")
        rows *= growth
    spark = annuli.sparkSession
    return best if best is not None else spark.createDataFrame([], "grp long, at int, slot int, score long, vec_id long, rank int")


def hard_negatives(vectors: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = 32, sample: int = 2048, block_rows: int = 1024, group_rows: int = 128, first_rows: int = 4096, growth: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, embedding and label; anchors tells the anchors among them. An anchor's positives are its best
    `positives` rows of the same label, and for each the best `negatives` rows of other labels follow whose score is
    low to high percent of the positive's."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["label"]
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite("embedding")
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(anchors, F.lit(False)).alias("anchor"), doubles("embedding").alias("vector"))
    rows = stored(_scaled(rows, scale), "scaled")
    n, most, dim = rows.agg(F.count(F.lit(1)), F.max("sq"), F.max(F.octet_length("x"))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    dim //= 4
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).toArrow()
    space = Space(dim, most, np.zeros((1, dim + 1)))
    x = _padded(some.column("x").combine_chunks(), dim).astype(np.float64)
    space.pivots = centers(np.concatenate([x, space.added(some.column("sq").to_numpy())[:, None]], axis=1), pivots)

    annuli = _blocks(rows, space, block_rows, False, "annuli")
    groups = _blocks(rows.where("anchor"), space, group_rows, True, "anchor-groups")
    none = F.array().cast("array<double>")
    repeat = lambda v: F.expr(f"unhex(repeat('{np.int64(v).tobytes().hex()}', n))")
    first = groups.select(F.col("block").alias("grp"), F.col("ids").alias("qids"), F.col("labels").alias("qlabels"), F.col("x").alias("qx"), none.alias("seen"), none.alias("reach"), repeat(NONE).alias("least"), repeat(-NONE - 1).alias("most"))
    good_ = _search(first, annuli, space, True, positives, first_rows, growth, kind)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One window for each positive; none, where there is none or its score is negative."""
        for batch in batches:
            least, most = [], []
            for r in range(batch.num_rows):
                size = len(batch.column("qids")[r])
                a, b = np.ones((size, positives), np.int64), np.zeros((size, positives), np.int64)
                for got in batch.column("found")[r].as_py() or []:
                    if got["score"] >= 0:
                        a[got["at"], got["rank"] - 1], b[got["at"], got["rank"] - 1] = -(-low * got["score"] // 100), high * got["score"] // 100
                least.append(a.tobytes())
                most.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "qids", "qlabels", "qx", "seen", "reach")), pa.array(least, pa.binary()), pa.array(most, pa.binary())], names=["grp", "qids", "qlabels", "qx", "seen", "reach", "least", "most"])

    found = good_.groupBy("grp").agg(F.collect_list(F.struct("at", "rank", "score")).alias("found"))
    second = first.drop("least", "most").join(found, "grp").mapInArrow(windows, QUERY.format(kind=kind))
    bad = _search(second, annuli, space, False, negatives, first_rows, growth, kind)
    named = groups.select(F.col("block").alias("grp"), F.posexplode("ids").alias("at", "anchor_id"))
    pairs = good_.select("grp", "at", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.select("grp", "at", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["grp", "at", "slot"]).join(named, ["grp", "at"])
    return out.select(empty.columns)
