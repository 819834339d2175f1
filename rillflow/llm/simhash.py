"""SimHash near-duplicates: exact links within a Hamming radius, and connected components of them.

Fingerprints are compared in tiles with exclusive-or and bit counts. Comparing all tiles with all would grow with the
square of the corpus, so tiles are first dealt to buckets: of k bands of bits two fingerprints within radius r agree in
k - r at least, and every bucket holds those that agree in one choice of k - r bands. k grows with the corpus, so that
buckets stay small; no link is lost at any k. A bucket is laid out by population count and cut into tiles. A fingerprint
meets only the tiles that hold counts within the radius of its own, and inside a pair of tiles blocks whose counts are
further apart are skipped. Each tile pair returns a forest that spans its links, not the links.

Copies share a fingerprint and are one node. Null and empty texts, and texts without words, have fingerprint zero and are
linked like any other. Rows with a null doc_id take part but can't name a component; a component of such rows only has a
null id. `classes` has a row for each repeated row, `representatives` one row for each component. Other columns are ignored.

With a similarity, `representatives` takes links only as candidates. Fingerprints are then those of the set of shingles, and
agreement in one of PAIRS pairs of least hashes deals them: texts of Jaccard similarity s agree in none with a chance of
(1 - s * s)**PAIRS. Whatever hangs together by candidates is gathered, or where that is much, each bucket, and its texts are linked by exact overlap.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import columns_of, map_rows, parts, written

BITS = 64
#: Fingerprints of one tile.
TILE = 4096
#: Fingerprints that a bucket may hold on average before bands are made narrower, and the number of choices of bands.
BUCKET = 64
MOST_CHOICES = 16
#: Shingles of one text whose hashes are held at once.
SHINGLES_AT_ONCE = 1 << 16
#: Pairs of least hashes that deal texts to buckets, each hash under an order of its own: 0.36**16 is 8e-8. Single hashes
#: would tie together texts that share no more than a frequent line.
PAIRS = 16
ORDERS = np.random.default_rng(7).integers(0, 1 << 63, 2 * PAIRS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Sets of shingles that one verifying step holds, or twice as many of two tiles.
SETS = 2048


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the text's word shingles, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(last), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[part].tolist(), last[part].tolist())], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def shingle_set(text: str | None, words_each: int, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of the text's word shingles in ascending order; shorter texts are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of distinct hashes, each counted once."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def least_hashes(hashes: np.ndarray) -> list[int]:
    """One number for each pair of least hashes."""
    if not len(hashes):
        return []
    least = np.array([(hashes * odd).min() for odd in ORDERS]).reshape(PAIRS, 2)
    return (least[:, 0] * ORDERS[0] ^ least[:, 1] * ORDERS[1]).view(np.int64).tolist()


def set_name(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.astype("<u8").tobytes())


def fingerprints(docs: DataFrame, *more: Column, words_each: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and strings `more`; a narrow pass over whole texts."""
    names = [f"more{k}" for k in range(len(more))]

    def per_batch(batch: pa.RecordBatch) -> list:
        found = [fingerprint(t, words_each) for t in batch.column(1).to_pylist()]
        return [batch.column(0), np.array(found, np.uint64).astype(np.int64), *batch.columns[2:]]

    given = docs.select(F.col("doc_id").cast("long"), "text", *(c.alias(n) for c, n in zip(more, names)))
    return map_rows(given, ", ".join(["doc_id long", "fp long", *(f"{n} string" for n in names)]), per_batch)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that span the links within left, or between left and right, by comparing blocks of numbers.

    Blocks follow the population count; those whose counts differ by more than the radius are skipped.
    """
    by_count = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    left = by_count(left)
    other = left if right is None else by_count(right)
    nodes = left if right is None else np.concatenate([left, other])
    counts, others = np.bitwise_count(left).astype(int), np.bitwise_count(other).astype(int)
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges, step = [], 256
    for a in range(0, len(left), step):
        part = left[a : a + step]
        b0 = max(int(np.searchsorted(others, counts[a] - radius)), a if right is None else 0)
        b1 = int(np.searchsorted(others, counts[a + len(part) - 1] + radius, "right"))
        near = np.bitwise_count(part[:, None] ^ other[None, b0:b1]) <= radius
        for i, j in np.argwhere(near).tolist():
            i, j = a + i, b0 + j + (0 if right is None else len(left))
            if i != j and (x := root(i)) != (y := root(j)):
                parent[x] = y
                edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def masks(n: int, radius: int) -> list[int]:
    """The bits of each choice of bands: two fingerprints within the radius agree in all bits of one mask at least.

    Of k bands `radius` may differ. More and narrower bands leave more bits to agree in, at the price of more choices.
    """
    k = radius + 1
    while n > BUCKET << (k - radius) * (BITS // k) and math.comb(k + 1, radius) <= MOST_CHOICES:
        k += 1
    edges = [BITS * i // k for i in range(k + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(bands, k - radius)]


def links(fps: DataFrame, radius: int = 2, tile: int = TILE, n: int = 0) -> DataFrame:
    """Edges a, b between distinct fingerprints whose components are those of all links within the radius.

    n tells how many fingerprints there are about. Where fps has a column `keys` (longs, as many in each row), only
    fingerprints that agree in one of them are compared.
    """
    if "keys" in fps.columns:
        rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.posexplode("keys").alias("choice", "key")).distinct()
    else:
        signed = (m - (1 << BITS) if m >> BITS - 1 else m for m in masks(n, radius))
        chosen = [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for k, m in enumerate(signed)]
        rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*chosen)).alias("_b")).select("fp", "pop", "_b.*")
    sizes = rows.groupBy("choice", "key", "pop").count()
    layout = F.collect_list(F.struct("pop", "count")).alias("layout")  # 65 counts at most
    buckets = sizes.groupBy("choice", "key").agg(F.sum("count").alias("n"), layout).filter("n > 1").drop("n")
    rows = rows.join(buckets, ["choice", "key"])
    before = lambda pop: F.aggregate(F.filter("layout", lambda e: e["pop"] < pop), F.lit(0).cast("bigint"), lambda x, e: x + e["count"])
    # A place in the bucket by population count, among equal ones by hash, and the first and last place within the radius.
    first, after = before(F.col("pop")), before(F.col("pop") + 1)
    at = lambda place: F.call_function("div", place, F.lit(tile)).cast("int")
    rows = rows.withColumn("own", at(first + F.pmod(F.xxhash64("fp"), after - first)))
    met = F.sequence(at(before(F.col("pop") - radius)), at(before(F.col("pop") + radius + 1) - 1))
    rows = rows.select("choice", "key", "fp", "own", F.explode(met).alias("met"))
    pairs = rows.select("choice", "key", "fp", F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), (F.col("own") <= F.col("met")).alias("first"))
    # Only buckets with two members or more are left; tasks take whole tile pairs and compare them one by one.
    tiles = ["choice", "key", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> pa.RecordBatch:
            out = []
            fp, first, alone = frame["fp"].to_numpy().view(np.uint64), frame["first"].to_numpy(), (frame["p"] == frame["q"]).to_numpy()
            cut = np.flatnonzero((frame[tiles].to_numpy()[1:] != frame[tiles].to_numpy()[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cut], [*cut, len(frame)]):
                if b - a == 2 and alone[a]:
                    if int(fp[a] ^ fp[a + 1]).bit_count() <= radius:
                        out.append((int(fp[a]), int(fp[a + 1])))
                elif b - a > 1:
                    one, part = fp[a:b], first[a:b]
                    out += forest(one, None, radius) if alone[a] else forest(one[part], one[~part], radius)
            ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:  # sorted by tile pair; the last pair of a batch may go on in the next
            frame = batch.to_pandas()
            if held:
                frame = pd.concat([*held, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[tiles] == frame[tiles].iloc[-1]).all(axis=1).to_numpy()
            begin = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
            if begin:
                yield flush(frame.iloc[:begin].reset_index(drop=True))
            held = [frame.iloc[begin:].reset_index(drop=True)]
        if held:
            yield flush(held[0])

    dealt = pairs.repartition(*tiles).sortWithinPartitions(*tiles)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root for each end of edges; root is one node of the component.

    Each round every node follows its neighbour that a fresh hash ranks lowest, and edges are redrawn between those; the
    graph shrinks by a constant share a round. The moves of all rounds are then joined from the last to the first.
    Every round is written to the shared folder, which cuts lineage.
    """
    edges = written(edges.filter("a <> b"), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        if len(moves) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)), F.col(c).alias("id"))  # noqa: E731, B023
        step = both.groupBy("node").agg(F.min(rank("near")).alias("low"))
        step = step.select("node", F.least("low", rank("node"))["id"].alias("root"))
        moves.append(written(step, "moves"))
        drawn = edges.join(moves[-1].toDF("a", "x"), "a").join(moves[-1].toDF("b", "y"), "b")
        edges = written(drawn.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1]
    for step in reversed(moves[:-1]):
        later = found.toDF("root", "last")
        found = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found


def placed(marked: DataFrame, radius: int, tile: int) -> DataFrame:
    """fp, n_copies, root and component_id of each fingerprint in marked (doc_id, fp)."""
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "nodes")
    roots = written(components(links(nodes.select("fp"), radius, tile, nodes.count())), "roots")
    found = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(named, "root").select("fp", "n_copies", "root", "component_id")


def classes(docs: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """One row for each of docs: doc_id, fingerprint, n_copies (rows with this fingerprint) and component_id."""
    marked = written(fingerprints(docs), "fingerprints")
    out = marked.join(placed(marked, radius, tile), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_copies", "component_id")


def similar_in(members: list[tuple[str, int, np.ndarray, bool]], radius: int, similarity: float, alone: bool) -> list[tuple[str, str]]:
    """Edges that span the pairs of (name, fingerprint, set, first) of at least that Jaccard similarity, within the radius.

    Not alone, only members of the first tile are compared with those of the second.
    """
    fps, sizes = np.array([m[1] for m in members], np.int64).view(np.uint64), np.array([len(m[2]) for m in members])
    first, root, edges = np.array([m[3] for m in members]), np.arange(len(members)), []
    for i in np.flatnonzero(first) if not alone else range(len(members) - 1):
        near = np.bitwise_count(fps ^ fps[i]) <= radius
        near &= np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
        if alone:
            near[: i + 1] = False
        else:
            near &= ~first
        for j in np.flatnonzero(near & (root != root[i])).tolist():
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(members[i][2], members[j][2], assume_unique=True))
            if both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9:
                root[root == root[j]] = root[i]
                edges.append((members[i][0], members[j][0]))
    return edges


def similar(sets: DataFrame, radius: int, similarity: float, held: int = SETS) -> DataFrame:
    """Edges a, b that span the links of similarity in each group of sets (name, fp, root, n members of root, hashes).

    root: any value that tells groups apart. A group of more than `held` members is compared tile by tile.
    """
    tiles = F.ceil(F.col("n") / held).cast("int")
    rows = sets.withColumn("sub", F.pmod(F.xxhash64("name"), tiles).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.select("root", F.least("sub", "t").alias("p"), F.greatest("sub", "t").alias("q"), (F.col("sub") <= F.col("t")).alias("first"), "name", "fp", "hashes")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []

        def flush() -> pa.RecordBatch:
            found = similar_in(members, radius, similarity, now[1] == now[2]) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.string()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:  # sorted by tile pair
            for root, p, q, first, name, fp, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, p, q) != now:
                    if members:
                        yield flush()
                    now, members = (root, p, q), []
                members.append((name, fp, np.frombuffer(hashes, "<u8"), first))
        if members:
            yield flush()

    return rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(verify, "a string, b string")


def candidates(members: DataFrame, held: int | None = None) -> DataFrame:
    """first, name and fp of each of members (first, name, fp, keys, root) in each group that it is verified in: root and its size n.

    What hangs together by candidates is one group. One of more than `held` members, and the candidates of a large corpus may
    form one of any size, is taken apart into the buckets that dealt its members, if fewer sets have to be sent so: a chain
    of candidates stays linear, while near copies, which share most buckets, are one group still.
    """
    held = held or SETS
    sent = lambda n: F.col(n) * F.ceil(F.col(n) / held)  # noqa: E731  as often as a group has tiles, each of its sets
    groups = members.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    told = members.join(groups, "root")
    dealt = told.filter(F.col("n") > held).select("first", "name", "fp", "root", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = dealt.groupBy("root", "key").agg(F.count("*").alias("own")).filter("own > 1")
    apart = sizes.groupBy("root").agg(F.sum(sent("own")).alias("sent")).join(groups, "root").filter(F.col("sent") < sent("n")).select("root")
    group = lambda key: F.struct("root", key.cast("long").alias("key")).alias("root")
    whole = told.join(apart, "root", "left_anti").select("first", "name", "fp", group(F.lit(None)), "n")
    parts_of = dealt.join(apart, "root", "left_semi").join(sizes, ["root", "key"])
    return whole.unionByName(parts_of.select("first", "name", "fp", group(F.col("key")), F.col("own").alias("n")))


def similar_representatives(docs: DataFrame, told: Column, radius: int, tile: int, words_each: int, similarity: float) -> DataFrame:
    """The key `told` of one row for each component of similar texts, as _near_key, and whether several rows have it."""
    spark = docs.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, words_each) for t in batch.column(1).to_pylist()]
            fps = np.array([set_fingerprint(h) for h in sets], np.uint64).astype(np.int64)
            columns = [pa.array(fps), pa.array([set_name(h) for h in sets], pa.string()), pa.array([least_hashes(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "told", "fp", "name", "keys"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = pa.array([shingle_set(t, words_each).astype("<u8").tobytes() for t in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), sets], names=["name", "hashes"])

    given = docs.select(F.col("doc_id").cast("long"), "text", told.alias("told"))
    marked = written(given.mapInArrow(sketch, "doc_id long, told string, fp long, name string, keys array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "told")).alias("first")
    nodes = written(marked.groupBy("name").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    roots = written(components(links(nodes.select("fp", "keys"), radius, tile)), "roots")
    near = written(candidates(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))), "candidates")
    wanted = near.select("name", F.col("first.told").alias("told")).distinct()
    texts = docs.select("text", told.alias("told")).join(wanted, "told").select("text", "name")
    sets = texts.mapInArrow(hashed, "name string, hashes binary").dropDuplicates(["name"]).join(near.select("name", "fp", "root", "n"), "name")
    joined = components(similar(sets, radius, similarity)).toDF("name", "to")
    least = nodes.select("name", "first").join(joined, "name", "left").groupBy(F.coalesce("to", "name").alias("to")).agg(F.min("first").alias("first"))
    return least.select(F.col("first.told").alias("_near_key")).join(repeats(marked, "told"), "_near_key", "left")


def repeats(marked: DataFrame, told: str) -> DataFrame:
    """The keys that several rows have, marked by _near_many."""
    found = marked.groupBy(F.col(told).alias("_near_key")).count().filter("count > 1")
    return found.select("_near_key", F.lit(True).alias("_near_many"))


def representatives(docs: DataFrame, radius: int = 2, tile: int = TILE, words_each: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of docs for each component: that of smallest doc_id, nulls last, and of these of smallest text digest.

    With a similarity, components are those of texts within the radius whose shingle sets overlap by at least that Jaccard
    similarity; else the radius alone decides. Rows alike in doc_id and text are one document, of which the row stays whose
    JSON has the least digest. Names that begin with `_near` are refused.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("_near")]:
        raise ValueError(f"reserved names: {', '.join(clash)}")
    told = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    if similarity is None:
        marked = written(fingerprints(docs, told, words_each=words_each), "fingerprints")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "more0"))
        # The least of each fingerprint, which a hot group finds before it is shuffled; then the least of each component.
        least = marked.groupBy("fp").agg(first.alias("first"))
        least = least.join(placed(marked, radius, tile), "fp").groupBy("root").agg(F.min("first").alias("first"))
        keep = least.select(F.col("first.more0").alias("_near_key")).join(repeats(marked, "more0"), "_near_key", "left")
    else:
        keep = similar_representatives(docs, told, radius, tile, words_each, similarity)
    keep, keyed = written(keep, "kept"), docs.withColumn("_near_key", told)
    single, many = keep.filter("_near_many IS NULL"), keep.filter("_near_many")
    out = keyed.join(single.select("_near_key"), "_near_key", "left_semi").select(*columns_of(docs))
    if many.isEmpty():
        return out
    whole = F.struct(*columns_of(docs))
    rows = keyed.join(many.select("_near_key"), "_near_key", "left_semi").groupBy("_near_key").agg(F.min_by(whole, F.md5(F.to_json(whole))).alias("_near_row"))
    return out.unionByName(rows.select("_near_row.*"))
