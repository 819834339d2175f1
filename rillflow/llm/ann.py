"""Approximate nearest neighbours by inner product: probed lists with an adaptive dimension scan.

Vectors get one more component so that all have the same length; then the largest inner product is the smallest Euclidean
distance. Lists are the cells of k-means centres fitted on a bounded sample, each centre with a second one added to it where
there are more lists than such a sample can tell apart; every row is put in its list. Within a probed list vectors are
rotated to the principal axes of the sample and read in blocks of columns. After each block a hypothesis test compares the
partial distance with what a true neighbour as far away as the query's distance to beat would have by then, and abandons
candidates that only few neighbours would look like. What is left is scored on the original vectors in double precision.

The nearest lists of each query, a first wave, give it a distance to beat for the others. A bounded sample of queries is
answered by brute force over all rows: the number of probed lists is the smallest that holds the wanted share of their true
neighbours, and the tests' limits are quantiles over those. A query whose lists hold too few rows goes on to all lists.

Lengths are handled as logarithms and vectors scaled by powers of two before anything is squared, so any finite vectors will
do. Vectors FAR powers of two longer than all but a hundredth of the others are an index of their own, for next to them the others
would all look alike; every query asks both. Products beyond the range of doubles count as doubles have them, undefined ones last.

Null, zero and non-finite vectors and those with a null component or id take no part. Each dimension is an index of its own,
for vectors of different dimensions have no inner product. Every row but the query's own is a candidate, rows that share its
id included; a query of a repeated id is answered once for each of its rows. Ties go to the smaller id. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import written

#: Bounds of the samples that the index is fitted and tuned on.
FIT_ROWS = 16_384
TUNE_QUERIES = 256
#: Centres of either level: a centre is fitted on 16 rows of the sample at least.
MOST_CENTRES = FIT_ROWS // 16
MOST_SECOND = 256
#: Rows of neighbouring lists, and queries, that one group compares.
CHUNK_ROWS = 2048
CHUNK_QUERIES = 1024
BLOCK = 16
#: Share of pairs still alive from which on they are looked at one by one.
SPARSE = 0.12
#: A vector is far longer than others from so many powers of two on.
FAR = 6
#: Width of the test where nothing was tuned, in the units of its authors; share of neighbours that a tuned test keeps.
DOUBT = 2.1
KEPT = 0.998


@dataclass
class Part:
    """The index of one dimension; its size depends on the number of lists and dimensions alone."""

    n: int
    scale: float  # power of two that vectors are multiplied by, so that the longest has a length next to 1
    reach: float  # squared length that all vectors are brought to
    first: np.ndarray  # centres, and what is added to them
    second: np.ndarray
    rotation: np.ndarray
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rows of each list

    @property
    def centres(self) -> np.ndarray:
        return (self.first[:, None] + self.second[None, :]).reshape(-1, self.first.shape[1])

    def groups(self) -> np.ndarray:
        """Of each list its group: neighbouring lists with CHUNK_ROWS rows at most, or one larger list."""
        out, at, held = np.zeros(len(self.sizes), np.int64), 0, 0
        for k, size in enumerate(self.sizes):
            if held and held + size > CHUNK_ROWS:
                at, held = at + 1, 0
            out[k], held = at, held + size
        return out


@dataclass
class Index:
    rows: DataFrame  # vec_id, row, vector, dim, list
    parts: dict[int, Part]  # by dimension, that of its far longer vectors with a minus


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def units(x: np.ndarray) -> np.ndarray:
    """Of each row a power of two that brings its length next to 1, where the vectors' own lengths are."""
    most = np.abs(x).max(1)
    power = np.rint(np.log2(most) + np.log2(((x / most[:, None]) ** 2).sum(1)) / 2)
    return np.ldexp(1.0, -np.clip(power, -1021, 1021).astype(int))


def products(a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products row by row; undefined ones are the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.einsum("ij,ij->i", a, e)
    return np.where(np.isnan(found), -np.inf, found)


def magnitude(vector: Column) -> Column:
    """Logarithm of the length to base two; nothing overflows on the way."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))

    def size(m: Column) -> Column:
        return F.log2(m) + F.log2(F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x.cast("double") / m) * (x.cast("double") / m))) / 2

    return F.transform(F.array(most), size)[0]  # a variable, which is computed once and not for each component


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(reach - (x * x).sum(1), 0.0))[:, None]])


def flat(q: np.ndarray) -> np.ndarray:
    """Queries have nothing in the added component: |q - x|^2 = |q|^2 + reach - 2 <q, x>."""
    return np.hstack([q, np.zeros((len(q), 1))])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([apart(part, centres).argmin(1) for part in np.array_split(x, max(1, len(x) // 2048))])


def k_means(sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        n = np.bincount(cell, minlength=lists)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fitted(sample: np.ndarray, n: int, longest: float, seed: int) -> Part:
    """Centres near each other have numbers near each other, so that a group of lists is probed by the same queries.

    longest: magnitude of the longest vector.
    """
    power = int(np.clip(np.rint(longest), -1021, 1021))
    scale, reach = 2.0**-power, float(4.0 ** (longest - power) * (1 + 1e-9))
    rng, x = np.random.default_rng(seed), lifted(sample * scale, reach)
    wanted = max(1, int(2 * n**0.5))
    lists = min(wanted, MOST_CENTRES, max(1, len(x) // 4))
    first = k_means(x, lists, rng)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    coarse = k_means(first, max(1, lists // 8), rng)
    first = first[np.lexsort((first @ axes[:, 0], nearest_centre(first, coarse)))]
    second = np.zeros((1, x.shape[1]))
    if wanted > lists == MOST_CENTRES:
        second = k_means(x - first[nearest_centre(x, first)], min(MOST_SECOND, -(-wanted // lists)), rng)
    return Part(n, scale, reach, first, second, axes)


def build(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 1) -> Index | None:
    """Fit each dimension on a sample of at most FIT_ROWS rows chosen by hash, and index every usable row; None if there is none."""
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    given = given.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    sized = given.withColumn("magnitude", magnitude(F.col("vector")))
    most, usual = F.max("magnitude").alias("most"), F.percentile_approx("magnitude", 0.99, 1000).alias("usual")
    found = sized.groupBy("dim").agg(F.count("*").alias("n"), most, usual).collect()  # one row for each dimension
    if not found:
        return None
    if edge := {r["dim"]: r["usual"] + FAR for r in found if r["most"] > r["usual"] + FAR}:
        far = F.element_at(F.create_map(*(F.lit(x) for pair in edge.items() for x in pair)), F.col("dim")) < F.col("magnitude")
        sized = sized.withColumn("dim", F.when(far, -F.col("dim")).otherwise(F.col("dim")))
        found = sized.groupBy("dim").agg(F.count("*").alias("n"), most).collect()
    given, parts = sized.drop("magnitude"), {}
    for r in sorted(found):
        own = given.filter(F.col("dim") == r["dim"])
        picked = own if r["n"] <= FIT_ROWS else own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(FIT_ROWS / r["n"] * (1 << 30)))
        sample = picked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").toPandas()["vector"]
        sample = sample if len(sample) else own.limit(1).toPandas()["vector"]
        parts[r["dim"]] = fitted(stacked(sample), r["n"], float(r["most"]), seed)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                part = parts[dim]
                x = lifted(stacked(own["vector"]) * part.scale, part.reach)
                cell = nearest_centre(x, part.first)
                yield own.assign(list=(cell * len(part.second) + nearest_centre(x - part.first[cell], part.second)).astype(np.int32))

    kind = given.schema["vector"].dataType.simpleString()
    numbered = given.select("vec_id", F.monotonically_increasing_id().alias("row"), "vector", "dim")
    rows = written(numbered.mapInPandas(place, f"vec_id long, row long, vector {kind}, dim int, list int"), "ann-index")
    for part in parts.values():
        part.sizes = np.zeros(len(part.first) * len(part.second), np.int64)
    for r in rows.groupBy("dim", "list").count().collect():  # one row for each list
        parts[r["dim"]].sizes[r["list"]] = r["count"]
    return Index(rows, parts)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(scores: np.ndarray, who: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each asker, ties to the smaller id."""
    order = np.lexsort((ids, -scores, who))
    head = np.r_[True, who[order][1:] != who[order][:-1]] if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def edges(d: int) -> list[int]:
    """Columns read after each block."""
    return [*range(BLOCK, d, BLOCK), d]


def truth(rows: DataFrame, part: Part, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The exact neighbours of a bounded set of queries over all rows: query_row, list, and the partial distances by block."""
    ask, own = stacked(queries["vector"]), queries["own"].to_numpy()
    turned, reach, rotation, scale = flat(ask * units(ask)[:, None]) @ part.rotation, part.reach, part.rotation, part.scale

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            e, ids = stacked(frame["vector"]), frame["vec_id"].to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                scores = ask @ e.T
            scores[np.isnan(scores)] = -np.inf
            scores[own[:, None] == frame["row"].to_numpy()[None, :]] = -np.inf
            top = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
            who, what = np.repeat(np.arange(len(ask)), top.shape[1]), top.ravel()
            gap = np.cumsum((turned[who] - (lifted(e * scale, reach) @ rotation)[what]) ** 2, axis=1)
            got = {"query_id": who, "query_row": who, "vec_id": ids[what], "list": frame["list"].to_numpy()[what], "score": scores[who, what]}
            got = pd.DataFrame(got | {"gaps": list(gap[:, [at - 1 for at in edges(gap.shape[1])]])})
            yield got[got["score"] > -np.inf]

    found = rows.mapInPandas(run, "query_id long, query_row long, vec_id long, list int, score double, gaps array<double>")
    return ranked(found, k).select("query_row", "list", "gaps").toPandas()


def tuned(rows: DataFrame, part: Part, queries: DataFrame, k: int, recall: float) -> tuple[int, np.ndarray]:
    """The fewest probed lists that hold `recall` of the sampled queries' true neighbours, and for each block the share of
    a neighbour's whole distance that KEPT of them stay below."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "query_row").limit(TUNE_QUERIES).select("own", "vector").toPandas()
    d = part.first.shape[1]
    found = truth(rows, part, sample, k)
    if not len(found):
        return 1, np.ones(len(edges(d)))
    ask = stacked(sample["vector"])
    order = np.argsort(apart(flat(ask * units(ask)[:, None]), part.centres), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    needed = np.sort(place[found["query_row"].to_numpy(), found["list"].to_numpy()])
    gaps = np.stack(found["gaps"].to_numpy())
    shares = np.quantile(gaps / np.maximum(gaps[:, -1:], 1e-300), KEPT, axis=0)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1, np.minimum(shares * (1 + 1e-9), 1.0)


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, shares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of one list that no block of rotated columns has ruled out. limit: distance to beat.

    Blocks are multiplied whole while many pairs are alive, and pair by pair when few are left.
    """
    n, d = x.shape
    ends = edges(d)
    if shares is None:
        shares = np.array([min(1.0, (1 + DOUBT / at**0.5) ** 2 * at / d) for at in ends])
    open_ended = np.isinf(limit)
    if open_ended.any() and n > k:
        some = apart(q[open_ended], x[: 4 * k])
        limit = limit.copy()
        limit[open_ended] = np.partition(some, k - 1, axis=1)[:, k - 1]
    near, pairs, begin = np.zeros((len(q), n)), None, 0
    for at, share in zip(ends, shares):
        cols, bound = slice(begin, at), (limit if at == d else limit * share) * (1 + 1e-9) + 1e-12
        if pairs is None:
            near += apart(q[:, cols], x[:, cols])
            alive = near <= bound[:, None]
            if at == d or alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                near = near[pairs]
        else:
            who, what = pairs
            gap = q[who, cols] - x[what, cols]
            near = near + np.einsum("ij,ij->i", gap, gap)
            ok = near <= bound[who]
            pairs, near = (who[ok], what[ok]), near[ok]
        begin = at
    return pairs


def probe(rows: DataFrame, part: Part, asks: DataFrame, k: int, shares: np.ndarray) -> DataFrame:
    """Hits of asks (query_id, query_row, own, vector, limit, lists) in their lists, k at most from each group.

    A query goes once to each group of lists that holds some of its own. Large lists, and the askers of a group, are cut
    into chunks by hash, so that a hot list or a common query is spread over tasks.
    """
    rotation, reach, scale, groups = part.rotation, part.reach, part.scale, part.groups()
    spark, kind = rows.sparkSession, rows.schema["vector"].dataType.simpleString()

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = frame["lists"].to_numpy()
            who = np.repeat(np.arange(len(frame)), [len(x) for x in lists])
            if not len(who):
                continue
            what = np.concatenate(lists)
            order = np.lexsort((groups[what], who))
            who, what = who[order], what[order]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (groups[what][1:] != groups[what][:-1])])
            out = frame.iloc[who[new]].drop(columns="lists").reset_index(drop=True)
            yield out.assign(group=groups[what[new]].astype(np.int32), lists=np.split(what.astype(np.int32), new[1:]))

    told = f"query_id long, query_row long, own long, vector {kind}, limit double, group int, lists array<int>"
    asks = written(asks.mapInPandas(dealt, told), "ann-asks")
    asked = dict(asks.groupBy("group").count().collect())  # one row for each group
    n_rows = np.bincount(groups, part.sizes, minlength=1)
    shape = [(int(g), max(1, -(-int(n_rows[g]) // CHUNK_ROWS)), -(-n // CHUNK_QUERIES)) for g, n in asked.items()]
    shape = F.broadcast(spark.createDataFrame(shape, "group int, cuts int, shares int"))  # as many rows as groups
    # Both sides of a cogroup must have keys of one type: other types hash differently.
    lists = F.broadcast(spark.createDataFrame(list(enumerate(groups.tolist())), "list int, group int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.join(lists, "list").join(shape, "group")
    rows = rows.select("vec_id", "row", "vector", "list", "group", F.pmod(F.xxhash64("row"), "cuts").cast("int").alias("chunk"), every(F.col("shares")).alias("part"))
    asks = asks.join(shape, "group").withColumn("part", F.pmod(F.xxhash64("query_row"), "shares").cast("int")).withColumn("chunk", every(F.col("cuts"))).drop("cuts", "shares")

    def compare(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})
        if not len(own) or not len(asked):
            return nothing
        e, a = stacked(own["vector"]), stacked(asked["vector"])
        ids, rows_of, cells, limit = (c.to_numpy() for c in (own["vec_id"], own["row"], own["list"], asked["limit"]))
        x, q = lifted(e * scale, reach) @ rotation, flat(a * units(a)[:, None]) @ rotation
        askers = np.repeat(np.arange(len(asked)), asked["lists"].map(len))
        wanted = np.concatenate(asked["lists"].to_numpy())
        found = []
        for cell in np.unique(cells):
            there, here = np.flatnonzero(cells == cell), askers[wanted == cell]
            if len(here):
                who, what = scan(x[there], q[here], limit[here], k + 1, shares)
                found.append((here[who], there[what]))
        if not found:
            return nothing
        who, what = (np.concatenate(c) for c in zip(*found))
        other = asked["own"].to_numpy()[who] != rows_of[what]
        who, what = who[other], what[other]
        scores = products(a[who], e[what])
        best = nearest(scores, who, ids[what], k)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[who[best]], "query_row": asked["query_row"].to_numpy()[who[best]], "vec_id": ids[what[best]], "score": scores[best]})

    keys = ["group", "chunk", "part"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(compare, "query_id long, query_row long, vec_id long, score double")


def search(index: Index | None, queries: DataFrame, k: int = 20, recall: float = 0.93) -> DataFrame:
    """The k nearest rows found for each of queries (rows of the index, or vec_id and vector): query_id, rank, vec_id, score.

    recall is that of the probed lists over a sample of the queries; the tests lose a little more.
    """
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = F.col("row") if "row" in queries.columns else F.lit(-1).cast("long")
    asked = written(queries.select("vec_id", own.alias("own"), "vector", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("query_row")), "ann-queries")
    out = [searched(index.rows.filter(F.col("dim") == dim), part, asked.filter(F.col("dim") == abs(dim)), k, recall) for dim, part in index.parts.items()]
    hits = out[0]
    for more in out[1:]:
        hits = hits.unionByName(more)
    if min(index.parts) < 0:  # a query has asked two indexes
        hits = ranked(hits.drop("rank"), k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def searched(rows: DataFrame, part: Part, queries: DataFrame, k: int, recall: float) -> DataFrame:
    """search within one dimension."""
    probes, shares = tuned(rows, part, queries, k, recall) if not queries.isEmpty() else (1, np.ones(len(edges(part.first.shape[1]))))
    kind = rows.schema["vector"].dataType.simpleString()

    def ask(most: int | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = part.centres
            for frame in frames:
                if len(frame):
                    whole = stacked(frame["vector"])
                    unit = units(whole)
                    q = whole * unit[:, None]
                    order = np.argsort(apart(flat(q), centres), axis=1)[:, :most].astype(np.int32)
                    yield pd.DataFrame({"query_id": frame["vec_id"], "query_row": frame["query_row"], "own": frame["own"], "vector": frame["vector"], "length": (q * q).sum(1), "unit": unit, "lists": list(order)})

        return lambda asked: asked.mapInPandas(run, f"query_id long, query_row long, own long, vector {kind}, length double, unit double, lists array<int>")

    columns = ["query_id", "query_row", "own", "vector"]
    asks, wave = written(ask(probes)(queries), "ann-lists"), -(-probes // 16)
    open_end = F.lit(float("inf")).alias("limit")
    hits = written(ranked(probe(rows, part, asks.select(*columns, open_end, F.slice("lists", 1, wave).alias("lists")), k, shares), k), "ann-first")
    if probes > wave:
        beat = hits.filter(F.col("rank") == k).select("query_row", F.col("score").alias("beat"))
        score = F.col("beat") * F.col("unit") * part.scale
        far = F.greatest(F.col("length") + part.reach - 2 * score, F.lit(0.0))
        limit = F.when(F.col("beat").isNull() | (F.abs(score) >= 4 * part.first.shape[1]), float("inf")).otherwise(far).alias("limit")
        more = asks.join(beat, "query_row", "left").select(*columns, limit, F.slice("lists", wave + 1, probes).alias("lists"))
        hits = written(ranked(hits.drop("rank").unionByName(probe(rows, part, more, k, shares)), k), "ann-second")
    enough = hits.groupBy("query_row").count().filter(F.col("count") >= k)
    short = queries.join(enough, "query_row", "left_anti")
    if probes < len(part.sizes) and not short.isEmpty():
        rest = ask(None)(short).select(*columns, open_end, F.slice("lists", probes + 1, len(part.sizes)).alias("lists"))
        hits = ranked(hits.drop("rank").unionByName(probe(rows, part, rest, k, np.ones(len(shares)))), k)
    return hits
