"""Toxicity by weak supervision.

1. Markers: word beginnings and whole words that are denser in toxic than in other labelled texts, mined from a bounded
   sample of labelled rows outside the held-out fold, next to a small fixed lexicon.
2. Voters: groups of markers and a few patterns; each votes `hit` or `no hit` on every text.
3. Label model: EM over the counts of all vote patterns of all documents estimates how often each voter hits in either
   class; the sample's labels anchor it. Voters that stay dependent given the class are joined to cliques with a joint
   table, and EM runs again.
4. A logistic classifier on marker densities is trained on the model's posterior labels and its output is calibrated on
   the sampled labels.

Null and empty texts have no hits and get the score of a text without hits. Rows with a null doc_id are scored and not
held out. A doc_id with several labels counts as toxic if any says so; of its rows the smallest text is learnt from. Without
labelled rows only the fixed lexicon and the patterns vote. Labels, lang, source and doc_id are never inputs of a score.

Labels enter more than the label model: markers are mined with them, vote limits and the EM's classes are set by them, and
the output is calibrated on them. Where there are thousands of labels the label model adds nothing to a classifier trained
on them (Settings.label_model; the README has figures); it is for corpora with few or none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_rows, parts, written

#: Insults that are plain in any English text.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting",
    "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard", "vermin", "filth", "degenerate", "cretin",
)
INSULT = re.compile(r"\byou(?:'re| are| were)?\s+(?:an?\s+|such\s+|all\s+)*(?:%s)" % "|".join(LEXICON))
THREAT = re.compile(r"\b(?:kill|hurt|hate|destroy) (?:you|them|him|her)\b|\bgo to hell\b|\bshut up\b|\bdrop dead\b")
#: Every threat holds one of these, which are faster to look for.
THREAT_PARTS = ("kill ", "hurt ", "hate ", "destroy ", "go to hell", "shut up", "drop dead")
LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST_PREFIX = 4, 8


@dataclass
class Settings:
    max_labelled: int = 12_000  # rows of the sample that markers, thresholds and the classifier are fitted on
    markers: int = 96
    voters: int = 16  # lexicon voters; the fixed lexicon and the patterns are further voters
    min_docs: int = 4  # toxic texts of the sample that a marker must stand in
    clique_bits: float = 0.01  # conditional mutual information beyond which two voters are joined
    label_model: bool = True  # False trains the classifier on the sample's own labels, for comparison


@dataclass
class Model:
    """Everything that scores a text; small, and shipped to executors with the closure."""

    markers: list[str]
    groups: list[list[int]]
    limits: list[float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    calibration: tuple[float, float] = (1.0, 0.0)
    accuracies: list[float] = field(default_factory=list)  # of each voter's hits, as the label model estimates them
    cliques: list[list[int]] = field(default_factory=list)  # voters that stay dependent given the class
    _automaton: object = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def counts(self, text: str | None) -> tuple[int, dict[int, int], list[bool]]:
        """Number of words, hits by marker, and what the patterns say."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for k, marker in enumerate(self.markers):
                self._automaton.add_word(marker.lstrip("="), (k, len(marker.lstrip("=")), marker[0] == "="))
            self._automaton.make_automaton()
        low = (text or "").lower()
        hits: dict[int, int] = {}
        for end, (k, size, whole) in self._automaton.iter(low):
            start = end - size + 1
            if (start == 0 or not low[start - 1].isalpha()) and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                hits[k] = hits.get(k, 0) + 1
        shout = text is not None and len(text) > 20 and text.isupper()
        insult = "you" in low and bool(INSULT.search(low))
        threat = any(part in low for part in THREAT_PARTS) and bool(THREAT.search(low))
        return len(low.split()), hits, [insult, threat, shout]

    def votes(self, n_words: int, hits: dict[int, int], patterns: list[bool]) -> int:
        """Bit j is set if voter j hits."""
        out = 0
        for j, (group, limit) in enumerate(zip(self.groups, self.limits)):
            total = sum(hits.get(k, 0) for k in group) if hits else 0
            out |= (total > 0 and total / max(n_words, 1) >= limit) << j
        for j, said in enumerate(patterns, len(self.groups)):
            out |= said << j
        return out

    def features(self, n_words: int, hits: dict[int, int], patterns: list[bool]) -> np.ndarray:
        x = np.zeros(2 * len(self.markers) + len(self.groups) + 3)
        for k, n in hits.items():
            x[k] = np.log1p(200.0 * n / max(n_words, 1))
            x[len(self.markers) + k] = 1.0
        for j, group in enumerate(self.groups):
            x[2 * len(self.markers) + j] = np.log1p(200.0 * sum(hits.get(k, 0) for k in group) / max(n_words, 1))
        x[-3:] = patterns
        return x

    def score(self, text: str | None) -> float:
        z = float(self.features(*self.counts(text)) @ self.weights + self.bias)
        z = self.calibration[0] * z + self.calibration[1]
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts with labels outside the held-out fold: all of them, or about `most` chosen by a hash of doc_id.

    A doc_id gives one text, however many rows it has. The sample is written, so that docs is read for it once.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # As many rows as the sample may have at most: broadcast, so that no text moves but the sample's.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))
    return written(rows.select("text", "_toxic"), "labelled")


def grams(word: str) -> list[str]:
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST_PREFIX) + 1)] + ["=" + word] * (len(word) >= 3)


def mined(sample: DataFrame, settings: Settings) -> list[str]:
    """The markers that set toxic texts of the sample apart, strongest first, without near-synonyms of a stronger one."""

    def run(batches):
        for batch in parts(batches):
            seen: dict[str, list[float]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = LETTERS.findall((text or "").lower())
                counts: dict[str, int] = {}
                for word in words:
                    for g in grams(word):
                        counts[g] = counts.get(g, 0) + 1
                for g, n in counts.items():
                    s = seen.setdefault(g, [0.0] * 6)
                    d, at = 1000.0 * n / len(words), 3 * bool(toxic)
                    s[at] += 1
                    s[at + 1] += d
                    s[at + 2] += d * d
            columns = [list(seen), *(map(list, zip(*seen.values())) if seen else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=["gram", *"abcdef"])

    sums = sample.mapInArrow(run, "gram string, a double, b double, c double, d double, e double, f double")
    sizes = {row["_toxic"]: row["count"] for row in sample.groupBy("_toxic").count().collect()}
    n0, n1 = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    sums = sums.groupBy("gram").agg(*(F.sum(c).alias(c) for c in "abcdef")).filter(F.col("d") >= settings.min_docs)
    mean0, mean1 = F.col("b") / n0, F.col("e") / n1
    spread = (F.col("c") / n0 - mean0 * mean0) / n0 + (F.col("f") / n1 - mean1 * mean1) / n1
    sums = sums.withColumn("z", (mean1 - mean0) / F.sqrt(spread + 1e-9)).filter("z > 3")
    chosen: list[tuple[str, float]] = []
    for row in sums.orderBy(F.desc("z"), "gram").select("gram", "d").limit(20 * settings.markers).collect():
        stem = row["gram"].lstrip("=")
        if all(not (stem.startswith(c.lstrip("=")) or c.lstrip("=").startswith(stem)) or min(row["d"], d) < 0.8 * max(row["d"], d) for c, d in chosen):
            chosen.append((row["gram"], row["d"]))
        if len(chosen) == settings.markers:
            break
    return [g for g, _ in chosen]


def label_model(patterns: np.ndarray, counts: np.ndarray, n_voters: int, anchor: tuple[np.ndarray, np.ndarray], settings: Settings) -> tuple[np.ndarray, list[list[int]], list[float]]:
    """EM over vote patterns; the posterior of each pattern, the cliques of dependent voters, accuracies by voter.

    A voter without a hit abstains: only hits are evidence, and the lack of any hit is one more voter. A clique of
    dependent voters is one voter whose vote is the combination of hits. anchor: patterns and labels of the sample; they
    enter every count beside the posterior, so that the classes keep their meaning.
    """
    spread = np.arange(n_voters)
    bits, known = (patterns[:, None] >> spread) & 1, (anchor[0][:, None] >> spread) & 1
    label = anchor[1]
    weight = max(1.0, 0.5 * counts.sum() / max(len(label), 1)) if len(label) else 0.0
    prior = (label.sum() + 1) / (len(label) + 10) if len(label) else 0.1

    def em(cliques: list[list[int]], posterior: np.ndarray) -> np.ndarray:
        codes = [(bits[:, c] << np.arange(len(c))).sum(axis=1) for c in cliques] + [np.where(bits.any(axis=1), 0, 1)]
        sure = [(known[:, c] << np.arange(len(c))).sum(axis=1) for c in cliques] + [np.where(known.any(axis=1), 0, 1)]
        for _ in range(100):
            odds = np.full(len(patterns), np.log(prior) - np.log(1 - prior))
            for code, there in zip(codes, sure):
                size = int(max(code.max(initial=0), there.max(initial=0))) + 1
                rates = []
                for w, v, part in ((posterior, label, prior), (1 - posterior, 1 - label, 1 - prior)):
                    t = np.bincount(code, weights=counts * w, minlength=size) + weight * np.bincount(there, weights=v, minlength=size)
                    rates.append((t + part) / (t.sum() + 1))
                odds += np.where(code > 0, np.log(rates[0][code] / rates[1][code]), 0.0)
            fresh = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(fresh - posterior).max(initial=0) < 1e-5:
                break
            posterior = fresh
        return posterior

    posterior = em([[j] for j in range(n_voters)], np.where(bits.any(axis=1), 0.7, 0.02))
    bonds = []
    for i in range(n_voters):
        for j in range(i):
            bond = 0.0
            for w in (counts * posterior, counts * (1 - posterior)):
                joint = np.bincount(2 * bits[:, i] + bits[:, j], weights=w, minlength=4).reshape(2, 2) + 1e-9
                joint /= joint.sum()
                apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                bond += float(w.sum() / counts.sum() * (joint * np.log2(joint / apart)).sum())
            bonds.append((bond, i, j))
    cliques = [[j] for j in range(n_voters)]
    for bond, i, j in sorted(bonds, reverse=True):
        a, b = (next(c for c in cliques if k in c) for k in (i, j))
        if bond > settings.clique_bits and a is not b and len(a) + len(b) <= 4:
            cliques = [c for c in cliques if c is not a and c is not b] + [a + b]
    posterior = em(cliques, posterior)
    right = [float((counts * bits[:, j] * posterior).sum() / max((counts * bits[:, j]).sum(), 1)) for j in range(n_voters)]
    return posterior, cliques, right


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on the labelled sample and on the vote patterns of all of docs.

    The driver gets the markers, the sample's hits and one count for each vote pattern, whose number is bounded by the
    number of voters; no text.
    """
    settings = settings or Settings()
    sample = labelled(docs, labels, settings.max_labelled)
    found = mined(sample, settings)
    fixed = [m for m in LEXICON if m not in found and "=" + m not in found]
    markers = found + fixed
    families: dict[str, list[int]] = {}
    for k, m in enumerate(found):
        families.setdefault(m.lstrip("=")[:SHORTEST], []).append(k)
    groups = list(families.values())[: settings.voters]
    for j, rest in enumerate(list(families.values())[settings.voters :]):
        groups[j % settings.voters] += rest
    groups.append([k for k, m in enumerate(markers) if m.lstrip("=") in LEXICON])
    model = Model(markers, groups, [0.0] * len(groups))

    def hits(batch: pa.RecordBatch) -> list:
        rows = [model.counts(t) for t in batch.column(0).to_pylist()]
        return [batch.column(1), [n for n, _, _ in rows], [",".join(f"{k}:{v}" for k, v in h.items()) for _, h, _ in rows], ["".join("01"[b] for b in p) for _, _, p in rows]]

    rows = map_rows(sample, "toxic int, n_words long, hits string, patterns string", hits).collect()
    seen = [(r["n_words"], {int(k): int(v) for k, v in (x.split(":") for x in r["hits"].split(",") if x)}, [c == "1" for c in r["patterns"]]) for r in rows]
    y = np.array([r["toxic"] for r in rows], float)
    for j, group in enumerate(groups):
        density = np.array([sum(h.get(k, 0) for k in group) / max(n, 1) for n, h, _ in seen])
        model.limits[j] = best_limit(density, y)

    def pattern(batch: pa.RecordBatch) -> list:
        return [[model.votes(*model.counts(t)) for t in batch.column(0).to_pylist()]]

    tally = map_rows(docs.select("text"), "votes long", pattern).groupBy("votes").count().collect()
    if not tally:
        return with_weights(model, np.zeros(2 * len(markers) + len(groups) + 3), -2.0)
    patterns, counts = np.array([r["votes"] for r in tally], np.int64), np.array([r["count"] for r in tally], float)
    anchor = np.array([model.votes(*s) for s in seen], np.int64), y
    posterior, model.cliques, model.accuracies = label_model(patterns, counts, len(groups) + 3, anchor, settings)
    soft = dict(zip(patterns.tolist(), posterior.tolist()))
    if not seen:
        basis = [(100, {k: n}, [False] * 3) for k in range(len(markers)) for n in (1, 2, 4)] + [(100, {}, [False] * 3)] * len(markers)
        seen, y = basis, np.array([float(bool(h)) for _, h, _ in basis])
    x = np.array([model.features(*s) for s in seen])
    target = np.array([soft.get(model.votes(*s), float(bool(s[1]))) for s in seen]) if settings.label_model or not rows else y
    weights, bias = logistic(x, target, ridge=1.0)
    with_weights(model, weights, bias)
    if 0 < y.sum() < len(y):
        z = x @ weights + bias
        scale, shift = logistic(z[:, None], y, ridge=1e-3)
        if scale[0] > 0:
            model.calibration = (float(scale[0]), shift)
    return model


def with_weights(model: Model, weights: np.ndarray, bias: float) -> Model:
    model.weights, model.bias = weights, bias
    return model


def best_limit(density: np.ndarray, y: np.ndarray) -> float:
    """The density from which a hit is right most often, counting toxic and other texts; 0 if every hit counts."""
    hit = density > 0
    if not hit.any() or not y.any():
        return 0.0
    order = np.argsort(-density[hit], kind="stable")
    d, t = density[hit][order], y[hit][order]
    gain = np.cumsum(2 * t - 1)
    last = np.append(d[1:] != d[:-1], True)
    best = int(np.argmax(np.where(last, gain, -np.inf)))
    return float(d[best])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each of docs; a narrow pass over whole texts."""

    def per_batch(batch: pa.RecordBatch) -> list:
        scores = [model.score(t) for t in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), scores, [int(s >= 0.5) for s in scores]]

    given = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(given, "doc_id long, held_out boolean, score double, predicted int", per_batch)


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below limit, all columns kept."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in parts(batches):
            yield batch.filter(pa.array([model.score(t) < limit for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
