"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

Equal vectors collapse to one group first. The trees' splits are fitted on a bounded sample of the groups (about
``sample`` of them, drawn by content hash) and every group is then routed to a leaf of each tree. A query
walks all trees through a shared queue ordered by its distance to the split planes, as far as ``share`` of the number
of vectors; buckets of neighbouring leaves meet their visitors, and every candidate is reranked by exact cosine in
double precision. A leaf grows with the corpus only beyond the sample; buckets are then dealt out in salted parts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, column, need

#: Vectors that the splits are fitted on, trees, and sampled vectors in a leaf.
SAMPLE, TREES, LEAF = 65_536, 24, 64
#: Neighbouring leaves of a tree that are searched together, and their rows that one part holds.
BUCKET, PART_ROWS = 128, 16_384
#: Cosines are compared in single precision first; what is nearer than this to the edge stays for the exact measure.
CLOSE = 4e-6


def share(n: int) -> float:
    """Leaf entries that a search visits, as a share of n vectors: falls with n, so that a search costs n to the 0.7.

    Measured on directions that are all alike, the hardest case (64 dimensions, 5 nearest, recall of 0.9 and more):
    2,000 vectors need all of them, 10,000 about 0.5 and 51,000 0.35. Clustered vectors need far less.
    """
    return 1.1 * (2000 / max(n, 1)) ** 0.3


@dataclass
class Tree:
    planes: list[np.ndarray] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    below: list[int] = field(default_factory=list)  # children of node i; a leaf is ~number
    above: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # sampled vectors of each leaf

    def arrays(self) -> Tree:
        self.planes, self.at = np.array(self.planes, np.float64), np.array(self.at)
        self.below, self.above = np.array(self.below, np.int64), np.array(self.above, np.int64)
        return self


def grow(vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """One tree over unit vectors: a node's plane lies between two of its vectors drawn at random, at the median."""
    tree = Tree()

    def node(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            tree.sizes.append(len(rows))
            return ~(len(tree.sizes) - 1)
        a, b = vectors[rng.choice(rows, 2, replace=False)]
        plane = a - b
        length = np.linalg.norm(plane)
        plane = plane / length if length > 0 else rng.standard_normal(vectors.shape[1])
        side = vectors[rows] @ plane
        cut = float(np.median(side))
        low = side < cut
        if not low.any() or low.all():  # ties: deal them out evenly, as a search looks on both sides of a tie
            low = np.arange(len(rows)) % 2 == 0
        me = len(tree.planes)
        tree.planes.append(plane)
        tree.at.append(cut)
        tree.below.append(0)
        tree.above.append(0)
        tree.below[me] = node(rows[low])
        tree.above[me] = node(rows[~low])
        return me

    if len(vectors):
        node(np.arange(len(vectors)))
    return tree.arrays()


def route(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    out = np.zeros(len(vectors), np.int64)
    if not len(tree.planes):
        return out
    todo = [(0, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = ~node
        elif len(rows):
            low = vectors[rows] @ tree.planes[node] < tree.at[node]
            todo += [(int(tree.below[node]), rows[low]), (int(tree.above[node]), rows[~low])]
    return out


def visit(trees: list[Tree], query: np.ndarray, search: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs, nearest first over all trees, until they hold ``search`` sampled vectors."""
    sides = [t.planes @ query - t.at if len(t.planes) else None for t in trees]
    queue = [(0.0, i, 0 if len(t.planes) else ~0) for i, t in enumerate(trees)]
    out, seen = [], 0
    while queue and seen < search:
        far, i, node = heapq.heappop(queue)
        t = trees[i]
        while node >= 0:
            side = sides[i][node]
            near, other = (t.below, t.above) if side < 0 else (t.above, t.below)
            heapq.heappush(queue, (max(far, abs(side)), i, int(other[node])))
            node = int(near[node])
        out.append((i, ~node))
        seen += max(1, t.sizes[~node])
    return out


def _matrix(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, leaf: int = LEAF, search: float | None = None, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """The k nearest rows of each query by cosine: ``query_id, rank, vec_id, score``.

    ``vectors`` needs ``vec_id`` and ``embedding``; ``is_query`` (over vec_id) chooses the queries, whose own rows
    are no candidates. Ties go to the smaller vec_id. A vector that is null, empty, zero or of another length than
    most, or that holds a null or non-finite component, takes no part, and neither does a null vec_id; rows
    repeated with their vec_id count once (of several vectors the one with the smallest content hash). An empty table gives an empty result. With fewer candidates than k all
    found are returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    out_schema = "query_id long, rank int, vec_id long, score double"
    e = F.col("embedding")
    usable = need(vectors, vec_id="long", embedding="array<double>").where("vec_id is not null and embedding is not null").where(F.size(e) > 0)
    usable = usable.where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0))
    width = usable.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not width:
        return spark.createDataFrame([], out_schema)
    # -0.0 and 0.0 are one value
    usable = usable.where(F.size(e) == width[0].n).withColumn("embedding", F.transform(e, lambda x: x + F.lit(0.0))).withColumn("gid", F.sha2(F.to_binary(F.hex(F.array_join(F.transform(e, lambda x: x.cast("string")), ",")), F.lit("hex")), 256))
    first = usable.withColumn("_r", F.row_number().over(W.partitionBy("vec_id").orderBy("gid"))).where(F.col("_r") == 1).drop("_r")
    usable = scratch.write(first, "vectors")
    # a group goes by its smallest vec_id; of equal vectors the k+1 smallest ids can be among anyone's nearest, and
    # Spark limits each task's part of a group first
    named = usable.groupBy("gid").agg(F.min("vec_id").alias("g"))
    both = usable.join(named, "gid")
    members = both.select("g", "vec_id").withColumn("_r", F.row_number().over(W.partitionBy("g").orderBy("vec_id"))).where(F.col("_r") <= k + 1).select("g", "vec_id")
    groups = scratch.write(both.where("vec_id = g").select("g", "gid", "embedding").withColumn("no", F.xxhash64("gid")), "groups")
    total = groups.count()

    some = groups if total <= sample else groups.where(F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(total)) < sample)
    fitted = sorted((r.no, r.embedding) for r in some.select("no", "embedding").toLocalIterator())
    fitted = _unit(np.array([v for _, v in fitted], np.float64)) if fitted else np.zeros((0, width[0].n))
    rng = np.random.default_rng(seed)
    forest = [grow(fitted, leaf, rng) for _ in range(trees)]
    del fitted
    sampled = max(1, min(total, sample))
    parts = max(1, -(-BUCKET * leaf * total // sampled // PART_ROWS))
    budget = int((share(total) if search is None else search) * sampled)

    def index(batch: pa.RecordBatch):
        g, emb, no = column(batch, "g"), column(batch, "embedding"), column(batch, "no").to_numpy()
        unit = _unit(_matrix(emb))
        for i, t in enumerate(forest):
            at = route(t, unit)
            yield {"tree": np.full(len(no), i, np.int32), "bucket": at // BUCKET, "part": no % parts, "leaf": at % BUCKET, "g": g, "embedding": emb.cast(pa.list_(pa.float32()))}

    def look(batch: pa.RecordBatch):
        ids, emb = column(batch, "vec_id").to_pylist(), column(batch, "embedding")
        unit = _unit(_matrix(emb))
        emb = emb.cast(pa.list_(pa.float32()))
        for r in range(len(ids)):
            seen: dict[tuple[int, int], list[int]] = {}
            for i, n in visit(forest, unit[r], budget):
                seen.setdefault((i, n // BUCKET), []).append(n % BUCKET)
            rows = [(i, b, p, x) for (i, b), x in seen.items() for p in range(parts)]
            at = pa.array([r] * len(rows), pa.int64())
            yield {"tree": [x[0] for x in rows], "bucket": [x[1] for x in rows], "part": [x[2] for x in rows], "leaves": [x[3] for x in rows], "query_id": pa.array([ids[r]] * len(rows), pa.int64()), "query": emb.take(at)}

    leaves = arrow_map(groups, index, "tree int, bucket long, part long, leaf long, g long, embedding array<float>")
    queries = usable.where(is_query)
    visits = arrow_map(queries, look, "tree int, bucket long, part long, leaves array<long>, query_id long, query array<float>")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k+1 best groups in the visited leaves of one part of a bucket, for each visitor."""
        q_, v_, s_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        if left.num_rows and right.num_rows:
            v, q = _matrix(right.column("embedding")), _matrix(left.column("query"))
            # in single precision, scaled so that no square overflows
            v, q = (x / np.maximum(np.abs(x).max(1), np.float32(1e-30))[:, None] for x in (v, q))
            v_len, q_len = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", q, q))
            leaf_of = right.column("leaf").to_numpy()
            wanted = left.column("leaves").combine_chunks()
            visitor = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy())
            visited = wanted.flatten().to_numpy()
            for x in np.unique(visited):
                rows, own = np.flatnonzero(leaf_of == x), visitor[visited == x]
                for at in range(0, len(own) if len(rows) else 0, 512):
                    who = own[at : at + 512]
                    s = (q[who] @ v[rows].T) / (q_len[who][:, None] * v_len[rows])
                    best = np.partition(s, max(0, s.shape[1] - k - 1), axis=1)[:, max(0, s.shape[1] - k - 1)]
                    # a tie at the edge stays in, so that ids decide it
                    r, c = np.nonzero(s >= best[:, None] - CLOSE)
                    q_.append(who[r])
                    v_.append(rows[c])
                    s_.append(s[r, c])
        who, found, near = np.concatenate(q_), np.concatenate(v_), np.concatenate(s_)
        order = np.lexsort((-near, who))
        who, found, near = who[order], found[order], near[order]
        start = np.searchsorted(who, who)
        edge = near[np.minimum(start + k, len(near) - 1)] if len(near) else near
        edge = np.where(np.searchsorted(who, who, "right") - start > k, edge, -2.0)
        keep = near >= edge - CLOSE
        ids, g = left.column("query_id").to_numpy(), right.column("g").to_numpy()
        return pa.table({"query_id": pa.array(ids[who[keep]] if len(ids) else [], pa.int64()), "g": pa.array(g[found[keep]] if len(g) else [], pa.int64()), "score": pa.array(near[keep].astype(np.float64), pa.float64())})

    met = visits.groupBy("tree", "bucket", "part").cogroup(leaves.groupBy("tree", "bucket", "part")).applyInArrow(rerank, "query_id long, g long, score double")
    found = met.groupBy("query_id", "g").agg(F.max("score").alias("near"))
    # the edge is the (k+1)-th; whatever single precision cannot tell from it stays
    ranked = found.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "g")))
    edge = ranked.where(F.col("_r") == k + 1).select("query_id", (F.col("near") - 2 * CLOSE).alias("_edge"))
    found = found.join(edge, "query_id", "left").where(F.col("_edge").isNull() | (F.col("near") >= F.col("_edge"))).drop("_edge")
    # the exact measure, the same for equal vectors whatever block they were compared in
    exact = found.join(groups.select("g", F.col("embedding").alias("v")), "g").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def cosine(batch: pa.RecordBatch) -> dict:
        q, v = _matrix(column(batch, "q")), _matrix(column(batch, "v"))
        s = np.array([float(a @ b) for a, b in zip(q, v, strict=True)]) / (np.sqrt(np.array([float(a @ a) for a in q])) * np.sqrt(np.array([float(b @ b) for b in v])))
        return {"query_id": column(batch, "query_id"), "g": column(batch, "g"), "score": s}

    scored = arrow_map(exact, cosine, "query_id long, g long, score double")
    named_rows = scored.join(members, "g").where("vec_id != query_id")
    ranked = named_rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
