"""Exact top-k by inner product with M-trees (Ciaccia, Patella, Zezula 1997).

Inner product is no metric, so each candidate x gets one more coordinate sqrt(R^2 - |x|^2), with
R the greatest norm in its tree, and each query a 0: then d^2 = |q|^2 + R^2 - 2 q.x, and the
nearest candidates are those of the greatest product. All candidates of a tree are bulk loaded
into paged nodes; an entry holds its routing object, covering radius and distance to the
parent's routing object. The search pops the page with the least possible distance first,
skips entries by the stored parent distance where the triangle inequality allows it without
computing a distance, and ends when no page can beat the k-th result. Bounds get a slack above
the rounding error, scores are integers, so results are exact, ties included.

Trees hold up to ``tree_rows`` vectors each and are rows of a table. A task takes a block of
queries through its share of the trees, one tree in memory at a time, and carries each query's
k-th score from tree to tree as its first bound. Blocks and trees are of bounded size, so memory
doesn't grow with the input, and no row comes to the driver.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm import shared

PAGE = 64
FANOUT = 16
_PAGES = "tree long, page int, leaf boolean, dims int, radius_top double, objects binary, radii binary, parents binary, refs binary"


def _padded(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == lengths[0]).all():
        return column.flatten().to_numpy().astype(np.int64).reshape(len(lengths), int(lengths[0]))
    return _padded(column.to_pylist(), int(lengths.max()) if len(lengths) else 0)


class _Loader:
    """Bulk loading: pages come out with children before parents, the root last."""

    def __init__(self, points: np.ndarray, page: int) -> None:
        self.points, self.page, self.pages = points, page, []

    def distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[rows] - self.points[to]) ** 2).sum(axis=1), 0))

    def load(self, rows: np.ndarray, router: int) -> tuple[int, float]:
        """(page number, covering radius about the router) of a subtree over the rows."""
        away = self.distances(rows, router)
        if len(rows) <= self.page:
            self.pages.append((True, rows, np.zeros(len(rows)), away, rows))
            return len(self.pages) - 1, float(away.max(initial=0))
        seeds = rows[np.linspace(0, len(rows) - 1, min(FANOUT, -(-len(rows) // self.page) * 2)).astype(int)]
        near = np.argmin(np.stack([self.distances(rows, s) for s in seeds]), axis=0)
        groups = [rows[near == i] for i in range(len(seeds))]
        if max(map(len, groups)) > 0.9 * len(rows):  # equal or nearly equal vectors: cut by number
            groups = np.array_split(rows, len(seeds))
            seeds = [g[0] if len(g) else 0 for g in groups]
        entries = [(s, *self.load(g, s)) for s, g in zip(seeds, groups, strict=True) if len(g)]
        routers = np.array([e[0] for e in entries])
        radii = np.array([e[2] for e in entries])
        parents = self.distances(routers, router)
        self.pages.append((False, routers, radii, parents, np.array([e[1] for e in entries])))
        return len(self.pages) - 1, float(max((parents + radii).max(), away.max()))


def _build(page: int):
    def run(table: pa.Table) -> pa.Table:
        ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        top = float(squares.max())
        loader = _Loader(np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(top - squares, 0))]), page)
        root = int(np.argmax(squares))
        loader.load(np.arange(len(ids)), root)
        rows = []
        for number, (leaf, objects, radii, parents, refs) in enumerate(loader.pages):
            refs = ids[refs] if leaf else refs
            rows.append((table.column("tree")[0].as_py(), number, leaf, vectors.shape[1], top, vectors[objects].tobytes(), radii.astype(float).tobytes(), parents.astype(float).tobytes(), refs.astype(np.int64).tobytes()))
        rows.append((rows[0][0], len(rows), False, vectors.shape[1], top, vectors[[root]].tobytes(), b"", b"", np.array([len(rows) - 1]).tobytes()))
        names = ["tree", "page", "leaf", "dims", "radius_top", "objects", "radii", "parents", "refs"]
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)})

    return run


class Tree:
    """A tree read from its pages."""

    def __init__(self, rows: list[dict]) -> None:
        self.pages = {}
        self.computed = 0
        for r in rows:
            objects = np.frombuffer(r["objects"], np.int64).reshape(-1, r["dims"])
            real = objects.astype(np.float64)
            extra = np.sqrt(np.maximum(r["radius_top"] - (real**2).sum(axis=1), 0))
            self.pages[r["page"]] = (r["leaf"], objects, real, extra, np.frombuffer(r["radii"]), np.frombuffer(r["parents"]), np.frombuffer(r["refs"], np.int64))
            self.top, self.dims = r["radius_top"], r["dims"]
        self.root = max(self.pages)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> None:
        """Bring the tree's best into ``best``, a heap of up to k (score, -id) of other trees; ``own`` is left out, ties go to the smaller id."""
        q = np.zeros(self.dims, np.int64)
        q[: min(self.dims, len(query))] = query[: self.dims]
        qf = q.astype(np.float64)
        norm = float(qf @ qf)
        slack = 1e-7 * (1 + math.sqrt(norm + self.top))
        reach = lambda: math.sqrt(max(norm + self.top - 2 * best[0][0], 0)) if len(best) == k else math.inf
        limit = reach()
        _, _, real, extra, _, _, refs = self.pages[self.root]
        start = float(np.sqrt(((real[0] - qf) ** 2).sum() + extra[0] ** 2))
        queue = [(0.0, int(refs[0]), start)]
        self.computed += 1
        while queue:
            least, number, parent = heapq.heappop(queue)
            if least > limit + slack:
                break
            leaf, objects, real, extra, radii, parents, refs = self.pages[number]
            rows = np.flatnonzero(np.abs(parent - parents) - radii <= limit + slack)
            self.computed += len(rows)
            if leaf:
                scores = objects[rows] @ q
                ids = refs[rows]
                if len(best) == k:
                    good = np.flatnonzero(scores >= best[0][0])
                    scores, ids = scores[good], ids[good]
                for item in sorted(((int(s), -int(i)) for s, i in zip(scores, ids, strict=True) if i != own), reverse=True)[:k]:
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    else:
                        break
                limit = reach()
                continue
            away = np.sqrt(np.maximum(((real[rows] - qf) ** 2).sum(axis=1) + extra[rows] ** 2, 0))
            for i, d in zip(rows.tolist(), away.tolist(), strict=True):
                bound = max(d - radii[i], 0.0)
                if bound <= limit + slack:
                    heapq.heappush(queue, (bound, int(refs[i]), d))


def _searched(k: int):
    """(query_id, vec_id, score) of the k best of each query block over its share of the trees, and a row without vec_id: the distances computed.

    Rows come sorted by share, queries before pages, pages by tree.
    """

    def run(batches):
        share, queries, found, computed, held = None, [], [], [], []

        def searched() -> None:
            tree = Tree(held)
            for i, (own, vector) in enumerate(queries):
                before = tree.computed
                tree.search(vector, own, k, found[i])
                computed[i] += tree.computed - before
            held.clear()

        def results() -> pa.RecordBatch:
            if held:
                searched()
            rows = [(q, -i, s) for (q, _), best in zip(queries, found, strict=True) for s, i in best] + [(q, None, n) for (q, _), n in zip(queries, computed, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["share"] != share:
                    if share is not None:
                        yield results()
                    share, queries, found, computed = row["share"], [], [], []
                if row["page"] is None:
                    queries.append((row["vec_id"], np.array(row["vector"], np.int64)))
                    found.append([])
                    computed.append(0)
                    continue
                if held and row["tree"] != held[0]["tree"]:
                    searched()
                held.append(row)
        if share is not None:
            yield results()

    return shared.trimmed(run)


def integer_vector(embedding: Column) -> Column:
    """floor(1024 * x) of each component as double; null where the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = 8192, page: int = PAGE, block: int = 2048, counted: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, itself left out by id.

    vectors, queries: vec_id and ``vector``, arrays of integers whose products fit 64 bits.
    Null ids or vectors take no part; a shorter vector is filled with 0. Rows that repeat a
    vec_id are candidates of their own, and one query with the least of their vectors. Equal scores rank by vec_id. Fewer candidates than k:
    all of them. Other columns are left out. No candidates or no queries: no rows. With
    ``counted`` a column computed says how many distances a query needed.
    """
    spark = vectors.sparkSession
    usable = "vec_id IS NOT NULL AND vector IS NOT NULL"
    vectors = shared.stage(shared.pick(vectors, "vec_id", "vector").where(usable), "vectors")
    trees = max(1, -(-vectors.count() // tree_rows))
    routed = vectors.withColumn("tree", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(trees)))
    pages = shared.stage(routed.groupBy("tree").applyInArrow(_build(page), _PAGES), "pages", **{"parquet.block.size": 16 << 20})
    queries = shared.stage(shared.pick(queries, "vec_id", "vector").where(usable).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    tasks = 3 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-queries.count() // block), -(-tasks // trees))  # few trees: smaller blocks, so that every core has one
    shares = max(1, min(trees, -(-tasks // blocks)))  # of the trees, for each block
    share = F.col("block") * shares + F.col("part")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("share", share)
    walked = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod("tree", F.lit(shares))).withColumn("share", share)
    rows = asked.drop("block", "part").unionByName(walked.drop("block", "part"), allowMissingColumns=True)
    rows = rows.repartitionById(blocks * shares, F.col("share").cast("int")).sortWithinPartitions("share", "tree", "page")
    found = rows.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    if counted:
        found = shared.stage(found, "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return ranked.join(found.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").alias("computed")), "query_id") if counted else ranked
