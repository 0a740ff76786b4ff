"""Most similar vectors for every vector: one hierarchical small-world graph per shard.

Vectors are unit length. A bounded sample gives coarse centres; each vector lives in the shard
of its nearest centre. Crowded cells get centres of their own, trained inside the cell, so the number
of shards has no bound. A vector also asks the shards on the far side of every border that
a neighbour of the wanted similarity may lie behind. A shard holds its graph as flat neighbour arrays,
one per level; the neighbours of its own vectors are known when the graph is laid, vectors
of other shards are searched in lockstep. Shard answers are made symmetric and merged into k per vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

#: Vectors of the sample that gives the centres (bound; every vector is indexed all the same).
SAMPLE = 20_000
#: Vectors a shard should hold, centres of the first level, vectors of a crowded cell that its own centres are trained on.
SHARD, CENTRES, CELL_SAMPLE = 4096, 4096, 20_000
#: Rows of a crowded cell that are placed by one task.
CELL_ROWS = 65_536
#: A border is crossed where a neighbour of the wanted similarity lies behind it at so many standard deviations of a random direction.
SPREAD = 2.0
#: Neighbours per node and level, links back to it at most, candidates looked at for them, ratio of level sizes.
LINKS, BACK, CANDIDATES, RATIO = 10, 6, 28, 16
#: Questions answered at once.
BATCH = 1024


def unit_vectors(df: DataFrame, row_id: str, vector: str, dims: int) -> DataFrame:
    """_id and _v (BINARY, float32 unit vector) of the usable rows, one per id.

    Usable: `dims` values, none null or not finite, not all zero. Rows with one id count once.
    """
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    usable = df.filter(F.col(row_id).isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    usable = usable.select(F.col(row_id).alias("_id"), v.cast("array<float>").alias("_f"), norm.alias("_n")).filter("_n > 0 AND _n < double('Infinity')")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.vstack(b["_f"].to_numpy()).astype(np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"_id": b["_id"], "_v": list(map(bytes, m.astype(np.float32)))})

    kind = usable.schema["_id"].dataType.simpleString()
    return usable.mapInPandas(pack, f"_id {kind}, _v binary").dropDuplicates(["_id"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def centres(sample: np.ndarray, count: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(seed)
    if count <= 1 or len(sample) <= count:
        return sample[: max(count, 1)].copy()
    c = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-9), c).astype(np.float32)
    return c


class Graph:
    """A hierarchical small-world graph over the rows of `v`, as flat neighbour arrays."""

    def __init__(self, v: np.ndarray, seed: int = 11):
        self.v, n = v, len(v)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.members, self.links, size = [np.arange(n, dtype=np.int32)], [], n
        while size > 4 * RATIO:
            size //= RATIO
            self.members.append(np.sort(order[:size]))
        self.nearest, self.similarity = None, None
        for level, ids in enumerate(self.members[:-1] or self.members):
            self.links.append(self._link(ids, keep=level == 0))

    def _link(self, ids: np.ndarray, keep: bool) -> np.ndarray:
        """Neighbour array of a level: close and diverse, filled with the next closest."""
        v, n = self.v[ids], len(ids)
        k = min(CANDIDATES, n - 1)
        if k <= 0:
            if keep:
                self.nearest, self.similarity = np.zeros((n, 0), np.int32), np.zeros((n, 0), np.float32)
            return np.zeros((n, 1), np.int32)
        cand, sims = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
        for a in range(0, n, BATCH):
            s = v[a : a + BATCH] @ v.T
            rows = np.arange(len(s))
            s[rows, rows + a] = -2
            top = np.argpartition(s, n - k, axis=1)[:, n - k :] if k < n else np.argsort(s, axis=1)
            got = np.take_along_axis(s, top, axis=1)
            best = np.argsort(-got, axis=1, kind="stable")
            cand[a : a + BATCH], sims[a : a + BATCH] = np.take_along_axis(top, best, axis=1), np.take_along_axis(got, best, axis=1)
        if keep:
            self.nearest, self.similarity = cand, sims
        m = min(LINKS, k)
        links = np.empty((n, m), np.int32)
        for a in range(0, n, BATCH):
            c, s = cand[a : a + BATCH], sims[a : a + BATCH]
            g = v[c]
            among = np.matmul(g, g.transpose(0, 2, 1))
            # a candidate is covered if an earlier kept one is closer to it than the node is
            kept = np.ones(c.shape, bool)
            for j in range(1, k):
                kept[:, j] = ~((among[:, j, :j] > s[:, j, None]) & kept[:, :j]).any(axis=1)
            order = np.argsort(~kept, axis=1, kind="stable")[:, :m]
            links[a : a + BATCH] = np.take_along_axis(c, order, axis=1)
        # links back, the closest first, so that groups that only link each other can be reached
        source, target = np.repeat(np.arange(n, dtype=np.int32), BACK), links[:, :BACK].ravel() if m >= BACK else np.repeat(links, -(-BACK // m), axis=1)[:, :BACK].ravel()
        closeness = np.einsum("nd,nd->n", v[source], v[target])
        order = np.lexsort((-closeness, target))
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        back = np.tile(links[:, -1:], (1, BACK))
        some = place < BACK
        back[target[some], place[some]] = source[some]
        links = np.concatenate((links, back), axis=1)
        lonely = np.setdiff1d(np.arange(n, dtype=np.int32), links)
        links[cand[lonely, 0], -1] = lonely
        return links

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, similarities) of the k nearest found for each row of q, best first."""
        ids, sims = [], []
        for a in range(0, len(q), BATCH):
            i, s = self._search(q[a : a + BATCH], k, max(ef, k))
            ids.append(i)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def _search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        top = self.members[-1]
        s = q @ self.v[top].T
        width = min(8, len(top))
        part = np.argpartition(s, len(top) - width, axis=1)[:, len(top) - width :]
        entry = top[part]
        for level in range(len(self.links) - 1, -1, -1):
            ids = self.members[level]
            local = np.searchsorted(ids, entry).astype(np.int32)
            wide = ef if level == 0 else 8
            found, sims = self._beam(q, ids, self.links[level], local, wide)
            entry = ids[found[:, : min(8, found.shape[1])]] if level else ids[found]
        return entry[:, :k], sims[:, :k]

    def _beam(self, q: np.ndarray, ids: np.ndarray, links: np.ndarray, entry: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        v, b, n = self.v[ids] if len(ids) < len(self.v) else self.v, len(q), len(ids)
        ef = min(ef, n)
        out_ids, out_sims = np.zeros((b, ef), np.int32), np.full((b, ef), -2, np.float32)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        np.put_along_axis(seen, entry.astype(np.int64), True, axis=1)
        beam = entry
        sims = np.einsum("bmd,bd->bm", v[beam], q)
        done = np.zeros(beam.shape, bool)
        best = np.argsort(-sims, axis=1)[:, :ef]
        beam, sims, done = np.take_along_axis(beam, best, 1), np.take_along_axis(sims, best, 1), np.take_along_axis(done, best, 1)
        while len(rows):
            pick = np.argsort(done, axis=1, kind="stable")[:, :step]
            fresh = ~np.take_along_axis(done, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            cand = np.sort(links[np.take_along_axis(beam, pick, 1)].reshape(len(rows), -1), axis=1)
            fresh_all = ~np.take_along_axis(seen, cand.astype(np.int64), 1)
            fresh_all[:, 1:] &= cand[:, 1:] != cand[:, :-1]
            np.put_along_axis(seen, cand.astype(np.int64), True, axis=1)
            # only what is new is measured
            r, c = np.nonzero(fresh_all)
            new = np.full(cand.shape, -2, np.float32)
            new[r, c] = np.einsum("nd,nd->n", v[cand[r, c]], q[r])
            beam, sims = np.concatenate((beam, cand), 1), np.concatenate((sims, new), 1)
            done = np.concatenate((done, ~fresh_all), 1)
            keep = min(ef, beam.shape[1])
            best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep] if keep < beam.shape[1] else np.argsort(-sims, axis=1)
            got = np.take_along_axis(sims, best, 1)
            best = np.take_along_axis(best, np.argsort(-got, axis=1), 1)
            beam, sims, done = np.take_along_axis(beam, best, 1), np.take_along_axis(sims, best, 1), np.take_along_axis(done, best, 1)
            over = done.all(axis=1) | ~fresh.any(axis=1)
            if over.any():
                w = beam.shape[1]
                out_ids[rows[over], :w], out_sims[rows[over], :w] = beam[over], sims[over]
                live = ~over
                rows, q, seen, beam, sims, done = rows[live], q[live], seen[live], beam[live], sims[live], done[live]
        return out_ids, out_sims


def reached(v: np.ndarray, c: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, mask of centres to ask) of unit vectors.

    A neighbour of the given similarity is sqrt(2 - 2 similarity) away, in a random direction this share of it
    divided by sqrt(dimensions); a centre is asked where the border to its cell is no further than SPREAD times that.
    """
    sims = v @ c.T
    near = sims.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    gap = sims[np.arange(len(v)), near][:, None] - sims
    return near, gap <= SPREAD * np.sqrt(max(2 - 2 * similarity, 0.0) / max(c.shape[1], 1)) * between[near]


def similar_vectors(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    ef: int = 32,
    reach: float = 0.4,
    min_similarity: float = -1.0,
    shard: int = SHARD,
    sample: int = SAMPLE,
    first_level: int = CENTRES,
) -> DataFrame:
    """a, b, similarity, rank: for each id a the k most similar other ids found (ties by smaller id).

    `vectors` and `queries` come from unit_vectors; without `queries` every vector asks, and a
    pair found from either side counts for both. Neighbours of a similarity of `reach` (or min_similarity, if that
    is more) are sought behind the borders of a cell; a lower `reach` asks more shards. Rows with equal vectors
    form one node, and every one of them gets its list; the k+1 smallest ids of a group stand for it in the lists
    of others, which is all a list of k can hold. Answers below min_similarity are dropped early. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    whole = queries is None
    kind = vectors.schema["_id"].dataType.simpleString()
    vectors = cut(vectors)
    n = vectors.count()
    count = int(min(max(1, -(-n // shard)), first_level))
    share = min(1.0, 1.2 * sample / max(n, 1))
    taken = (vectors.select("_v").sample(share, seed=5) if share < 1 else vectors.select("_v")).limit(sample).toPandas()["_v"].unique()
    middle = sc.broadcast(centres(_matrix(taken), count) if len(taken) else np.zeros((1, 1), np.float32))
    wanted = max(reach, min_similarity)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"_id": b["_id"], "_v": b["_v"], "_c": (_matrix(b["_v"]) @ middle.value.T).argmax(axis=1).astype(np.int32)})

    placed = cut(vectors.groupBy("_v").agg(F.min("_id").alias("_id")).select("_id", "_v").mapInPandas(place, f"_id {kind}, _v binary, _c int"))
    # equal vectors meet by 128 bits, so the join is narrow
    digest = [F.xxhash64("_v").alias("_h"), F.xxhash64("_v", F.lit(7)).alias("_g")]
    rows = cut(vectors.select("_id", *digest).join(placed.select(F.col("_id").alias("_node"), *digest), ["_h", "_g"]).select("_id", "_node"))
    order = Window.partitionBy("_node").orderBy("_id")
    heads = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).groupBy("_node").agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    crowd = {r["_c"]: r["n"] for r in placed.groupBy("_c").agg(F.count("*").alias("n")).collect() if r["n"] > 2 * shard}  # at most CENTRES rows
    crowded = F.col("_c").isin(list(crowd)) if crowd else F.lit(False)
    schema = f"_c int, _s int, _id {kind}, _v binary, _q tinyint"

    def moved(b: pd.DataFrame, cells: np.ndarray, shards: np.ndarray, row: np.ndarray, asks: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"_c": cells.astype(np.int32), "_s": shards.astype(np.int32), "_id": b["_id"].to_numpy()[row], "_v": b["_v"].to_numpy()[row], "_q": asks.astype(np.int8)})

    def living(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Vectors in their cell; where all ask, also in the other cells they ask."""
        for b in batches:
            if len(b):
                own = b["_c"].to_numpy()
                yield moved(b, own, np.zeros(len(b)), np.arange(len(b)), np.zeros(len(b)))
                if whole:
                    _, ask = reached(_matrix(b["_v"]), middle.value, wanted)
                    ask[np.arange(len(b)), own] = False
                    row, cell = np.nonzero(ask)
                    yield moved(b, cell, np.zeros(len(row)), row, np.ones(len(row)))

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, cell = np.nonzero(reached(_matrix(b["_v"]), middle.value, wanted)[1])
                yield moved(b, cell, np.zeros(len(row)), row, np.ones(len(row)))

    spread = placed.mapInPandas(living, schema)
    if not whole:
        askers = cut(queries.groupBy("_v").agg(F.min("_id").alias("_id")))
        ask_rows = queries.select("_id", "_v").join(askers.select("_v", F.col("_id").alias("_node")), "_v").select("_id", "_node")
        spread = spread.unionByName(askers.select("_id", "_v").mapInPandas(asking, schema))
    if crowd:
        sizes = sc.broadcast(crowd)

        def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                some = pd.util.hash_array(b["_id"].to_numpy()).astype(np.float64) / 2.0**64 < CELL_SAMPLE / b["_c"].map(sizes.value).to_numpy(np.float64)
                yield b.loc[some, ["_c", "_v"]]

        def trained(cell: pd.DataFrame) -> pd.DataFrame:
            v, c = _matrix(cell["_v"]), int(cell["_c"].iloc[0])
            own = centres(v, min(-(-sizes.value[c] // shard), max(len(v) // 4, 1)))
            salts = -(-4 * sizes.value[c] // CELL_ROWS)
            return pd.DataFrame({"_c": np.int32(c), "_z": np.arange(salts, dtype=np.int32), "centres": own.astype(np.float32).tobytes()})

        inner = placed.filter(crowded).select("_id", "_c", "_v").mapInPandas(thinned, "_c int, _v binary").groupBy("_c").applyInPandas(trained, "_c int, _z int, centres binary")
        salts = F.create_map(*[F.lit(x) for c, m in crowd.items() for x in (c, -(-4 * m // CELL_ROWS))])
        inside = spread.filter(crowded).withColumn("_z", F.pmod(F.xxhash64("_id"), F.element_at(salts, F.col("_c"))).cast("int"))

        def placed_again(b: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            """Rows of a crowded cell in the shards of its own centres."""
            if b.empty or own.empty:
                return pd.DataFrame({"_c": [], "_s": [], "_id": b["_id"][:0], "_v": b["_v"][:0], "_q": []}).astype({"_c": "int32", "_s": "int32", "_q": "int8"})
            c = np.frombuffer(own["centres"].iloc[0], np.float32).reshape(-1, len(b["_v"].iloc[0]) // 4)
            out = []
            for a in range(0, len(b), 4096):
                part = b.iloc[a : a + 4096]
                q, cell = part["_q"].to_numpy(), part["_c"].to_numpy()
                near, ask = reached(_matrix(part["_v"]), c, wanted)
                lives = np.flatnonzero(q == 0)
                out.append(moved(part, cell[lives], near[lives], lives, np.zeros(len(lives))))
                ask[lives, near[lives]] = False
                if not whole:
                    ask[lives] = False
                row, s = np.nonzero(ask)
                out.append(moved(part, cell[row], s, row, np.ones(len(row))))
            return pd.concat(out)

        again = inside.groupBy("_c", "_z").cogroup(inner.groupBy("_c", "_z")).applyInPandas(placed_again, schema)
        spread = spread.filter(~crowded).unionByName(again)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        own, q = rows[rows["_q"] == 0].sort_values("_id"), rows[rows["_q"] == 1]
        out = []
        if len(own) and (whole or len(q)):
            ids = own["_id"].to_numpy()
            graph = Graph(_matrix(own["_v"]))
            if whole:
                if k <= CANDIDATES:  # compared while the graph was laid
                    out.append((ids, graph.nearest[:, :k], graph.similarity[:, :k]))
                else:
                    out.append((ids, *graph.search(graph.v, k + 1, ef)))
            if len(q):
                out.append((q["_id"].to_numpy(), *graph.search(_matrix(q["_v"]), k + (not whole), ef)))
        if not out:
            return pd.DataFrame({"a": rows["_id"][:0], "b": rows["_id"][:0], "s": pd.Series(dtype="float32")})
        a = np.concatenate([np.repeat(h, i.shape[1]) for h, i, _ in out])
        b, s = np.concatenate([ids[i.ravel()] for _, i, _ in out]), np.concatenate([x.ravel() for _, _, x in out])
        ok = ((a != b) | (not whole)) & (s >= min_similarity)
        return pd.DataFrame({"a": a[ok], "b": b[ok], "s": s[ok]})

    pairs = spread.groupBy("_c", "_s").applyInPandas(answer, f"a {kind}, b {kind}, s float")
    if whole:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
        itself, ask_rows = rows.select(F.col("_node").alias("a")).distinct().select("a", F.col("a").alias("b")), rows
    else:
        itself = askers.select(F.col("_id").alias("a"), *digest).join(placed.select(F.col("_id").alias("b"), *digest), ["_h", "_g"]).select("a", "b")
    pairs = pairs.unionByName(itself.select("a", "b", F.lit(2.0).cast("float").alias("s")))
    pairs = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    # a node stands for one row at least, so its k+1 nearest nodes hold all of its k nearest rows
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc(), "b"))).filter(F.col("_r") <= k + 1).drop("_r")
    held = best.join(heads.withColumnRenamed("_node", "b"), "b").select("a", F.least("s", F.lit(1.0).cast("float")).alias("s"), F.explode("ids").alias("id"))
    lists = held.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "id"))), 1, k + 1).alias("near"))
    each = ask_rows.join(lists.withColumnRenamed("a", "_node"), "_node")
    each = each.select(F.col("_id").alias("a"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("_id")), 1, k)).alias("p", "x"))
    each = each.filter(-F.col("x.d") >= min_similarity)
    return each.select("a", F.col("x.id").alias("b"), (-F.col("x.d")).cast("double").alias("similarity"), (F.col("p") + 1).alias("rank"))


def mutual_pairs(lists: DataFrame) -> DataFrame:
    """a, b, similarity with a < b where each is in the other's list."""
    pair = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.count("*").alias("_n"), F.max("similarity").alias("similarity")).filter("_n = 2").drop("_n")
