"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of an example is a term, and so are those beginnings of words that tell the classes apart. Weights are TF-IDF,
counted over all documents; terms that tell toxic from clean examples (likelihood ratio, with a bound for the number of
terms looked at) weigh more. A bounded sample of labelled examples is indexed in blocks, with the largest weight of each term
in each block. Queries go in batches: the blocks of the highest bounds come first, and others are left out by the queries
whose k-th neighbour their bounds can't reach, so neighbours are exact. Similarities weigh the votes; a logistic curve fitted on
left-out examples calibrates them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, lean, spread
from lamplight.llm.minhash import word_hashes
from lamplight.llm.resample import bounded, learned

HEADS = (4, 5)  #: bytes of word beginnings
#: Words are runs of ASCII letters and of bytes beyond ASCII.
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Params:
    """examples: labelled rows of each class that are learned from, at most. support: fewest toxic examples with a telling
    term. telling: factor of a telling term's weight. k: neighbours; those that tie with the last vote too. block: examples of
    a block of the index. dense: most frequent terms, whose weights are a matrix; others have postings. batch: queries that
    are answered together. power: of a similarity as a vote. prior: weight of the base rate among votes. evidence: neighbours
    that are returned. calibrate: examples that the curve is fitted on, at most."""

    examples: int = 2_000
    support: int = 3
    telling: float = 6.0
    k: int = 25
    block: int = 256
    dense: int = 256
    batch: int = 64
    power: float = 2.0
    prior: float = 0.05
    evidence: int = 5
    calibrate: int = 2000


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the distinct words and then of their beginnings, their counts, and how many of them are words."""
    words, _, *heads = word_hashes((text or "").lower().encode(), _GAP, HEADS)
    a, n = np.unique(words, return_counts=True)
    b, m = np.unique(np.concatenate(heads), return_counts=True)
    return np.concatenate((a, b)), np.concatenate((n, m)).astype(np.int32), len(a)


def telling(a: np.ndarray, b: np.ndarray, toxic: int, clean: int, support: int) -> np.ndarray:
    """Whether a term, in a toxic and b clean examples, is more frequent in toxic ones, by log-likelihood ratio above that of
    chance in any of the terms."""
    q = (a + b) / (toxic + clean)

    def part(x, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (n * p)), 0.0)

    ratio = 2 * (part(a, toxic, q) + part(b, clean, q) + part(toxic - a, toxic, 1 - q) + part(clean - b, clean, 1 - q))
    return (a >= support) & (a * clean > 3 * b * toxic) & (ratio >= 2 * np.log(max(len(a), 2)) + 4)


@dataclass
class Vocabulary:
    """Sorted hashes of the terms, the factor of each, and its weight once documents are counted."""

    hashes: np.ndarray
    factor: np.ndarray
    weight: np.ndarray | None = None

    def find(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, counts) of those hashes that are terms, ascending."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        at, counts = at[known], counts[known]
        order = np.argsort(at, kind="stable")
        return at[order], counts[order]

    def weigh(self, found: np.ndarray, total: int) -> None:
        """found: of total documents, how many have each term."""
        self.weight = (np.log((total + 1) / (np.minimum(found, total) + 1)) + 0.05) * self.factor

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weights of a text's terms, of length 1, as the index stores them."""
        w = (1 + np.log(counts)) * self.weight[at]
        return (w / np.sqrt((w * w).sum())).astype(np.float32) if len(w) else w.astype(np.float32)


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, p: Params) -> Vocabulary:
    """All words of the examples and their telling beginnings."""
    toxic, clean, parts = int(labels.sum()), int(len(labels) - labels.sum()), []
    for words in (True, False):
        hashes = [h[:n] if words else h[n:] for h, _, n in examples]
        names, at = np.unique(np.concatenate(hashes), return_inverse=True)
        of = np.repeat(labels, [len(h) for h in hashes])
        a, b = np.bincount(at, of, len(names)), np.bincount(at, 1 - of, len(names))
        tells = telling(a, b, toxic, clean, p.support)
        keep = tells | words
        parts.append((names[keep], np.where(tells, p.telling, 1.0)[keep]))
    names, first = np.unique(np.concatenate([x for x, _ in parts]), return_index=True)
    return Vocabulary(names, np.concatenate([x for _, x in parts])[first])


@dataclass
class Index:
    """A block-max inverted index of the examples' unit vectors (terms, weights), with doc_ids and labels."""

    p: Params
    words: Vocabulary
    ids: np.ndarray
    labels: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    curve: tuple[float, float] = (0.0, 1.0)
    base: float = 0.5
    known: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        n, v, size = len(self.rows), len(self.words.hashes), self.p.block
        self.base = (self.labels.sum() + 0.5) / (n + 1)
        term = np.concatenate([t for t, _ in self.rows]) if n else np.zeros(0, np.int64)
        common = np.argsort(-np.bincount(term, minlength=v), kind="stable")[: self.p.dense]
        self.column = np.full(v, -1, np.int32)
        self.column[common] = np.arange(len(common))
        # like examples share blocks: order by their two heaviest common terms
        order = np.lexsort((self.ids, *np.array([self._heaviest(t, w) for t, w in self.rows]).reshape(n, 2).T[::-1]))
        self.ids, self.labels = self.ids[order], self.labels[order]
        rows = [self.rows[i] for i in order.tolist()]
        self.rows = []  # from here on the postings are the vectors
        owner, weight = np.repeat(np.arange(n), [len(t) for t, _ in rows]), np.concatenate([w for _, w in rows]) if n else np.zeros(0, np.float32)
        term = np.concatenate([t for t, _ in rows]) if n else term
        self.blocks = -(-n // size)
        often = self.column[term] >= 0
        self.dense = np.zeros((len(common), self.blocks * size))
        self.dense[self.column[term[often]], owner[often]] = weight[often]
        self.dense_most = self.dense.reshape(len(common), self.blocks, size).max(axis=2)
        term, owner, weight = term[~often], owner[~often], weight[~often]
        order = np.lexsort((owner, term))
        term, owner, self.post_weight = term[order], owner[order], weight[order]
        self.post = (owner % size).astype(np.int32)
        entry = np.flatnonzero(np.diff(term * max(1, self.blocks) + owner // size, prepend=-1))  # where (term, block) begins
        self.entry_block, self.entry_at = (owner[entry] // size).astype(np.int32), np.append(entry, len(term)).astype(np.int64)
        self.entry_most = np.maximum.reduceat(self.post_weight, entry) if len(entry) else np.zeros(0, np.float32)
        self.at = np.searchsorted(term[entry], np.arange(v + 1))

    def _heaviest(self, t: np.ndarray, w: np.ndarray) -> tuple[int, int]:
        c = self.column[t]
        best = c[c >= 0][np.argsort(-w[c >= 0], kind="stable")[:2]].tolist()
        return (*best, *[len(self.column)] * (2 - len(best)))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (terms, unit weights): (examples, similarities) of the k nearest with a term in common, and of all that
        tie with the k-th; nearest first, then by doc_id. Similarities are sums in double precision, to 12 places.

        The blocks of the highest bounds give each query a k-th similarity at least; of the others, a query looks at those
        whose bound reaches it.
        """
        q, size, total = len(queries), self.p.block, self.blocks * self.p.block
        common = np.zeros((q, len(self.dense)))
        ranges = []
        for i, (t, w) in enumerate(queries):
            c = self.column[t]
            common[i, c[c >= 0]] = w[c >= 0]
            rare = t[c < 0]
            a, n = self.at[rare], self.at[rare + 1] - self.at[rare]
            ranges.append((a, n, np.full(len(rare), i), w[c < 0]))
        a, n, owner, weight = (np.concatenate(x) for x in zip(*ranges, strict=True))
        entry = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner, weight = np.repeat(owner, n), np.repeat(weight.astype(np.float64), n)
        pair = owner * self.blocks + self.entry_block[entry]
        bound = common @ self.dense_most + np.bincount(pair, weight * self.entry_most[entry], q * self.blocks).reshape(q, self.blocks)
        score = np.zeros((q, total))

        def look(live: np.ndarray) -> None:
            """Adds the similarities of pairs of a query and a block."""
            blocks = np.flatnonzero(live.any(axis=0))
            columns = (blocks[:, None] * size + np.arange(size)).reshape(-1)
            if len(blocks) == self.blocks:
                np.add(score, common @ self.dense, out=score)
            else:
                score[:, columns] += common @ self.dense[:, columns]
            e = np.flatnonzero(live.reshape(-1)[pair])
            m = self.entry_at[entry[e] + 1] - self.entry_at[entry[e]]
            post = np.repeat(self.entry_at[entry[e]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            score.reshape(-1)[:] += np.bincount(np.repeat(pair[e] * size, m) + self.post[post], np.repeat(weight[e], m) * self.post_weight[post], q * total)

        first = np.zeros((q, self.blocks), bool)
        first[:, np.argsort(-bound.sum(axis=0), kind="stable")[: max(1, -(-2 * k // size))]] = True
        look(first)
        last = lambda: np.partition(score, total - k, axis=1)[:, total - k, None] if total >= k else np.zeros((q, 1))
        rest = (bound >= last() - 1e-9) & (bound > 0) & ~first
        if rest.any():
            look(rest)
            score.reshape(q, self.blocks, size)[~(rest | first)] = 0
        who, what = np.nonzero((score >= last() - 1e-9) & (score > 0))
        s = np.round(score[who, what], 12)
        order = np.lexsort((self.ids[what], -s, who))
        who, what, s = who[order], what[order], s[order]
        cut = np.searchsorted(who, np.arange(q + 1))
        out = []
        for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            y = y if y - x <= k else x + int(np.searchsorted(-s[x:y], -s[x + k - 1], "right"))
            out.append((what[x:y], s[x:y]))
        return out

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        w = s**self.p.power
        return float(((w * self.labels[i]).sum() + self.p.prior * self.base) / (w.sum() + self.p.prior))

    def calibrate(self, sample: list[tuple[int, np.ndarray, np.ndarray]], share: float) -> None:
        """Fits the curve on examples (doc_id, terms, weights), each by its neighbours without itself. share: of toxic rows
        among all that are labelled; the sample's classes count as much."""
        place, x, y = {int(d): i for i, d in enumerate(self.ids)}, [], []
        for at in range(0, len(sample), self.p.batch):
            part = sample[at : at + self.p.batch]
            for (doc, *_), (i, s) in zip(part, self.nearest([q[1:] for q in part], self.p.k + 1), strict=True):
                other = i != place[doc]
                x.append(self.vote(i[other], s[other]))
                y.append(self.labels[place[doc]])
        x, y = np.array(x), np.array(y, float)
        if not 0 < y.sum() < len(y):
            return
        each = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        z, (a, b) = np.log(x / (1 - x)), (0.0, 1.0)
        for _ in range(100):  # Newton steps, with a weak pull to the curve that changes nothing
            r = 1 / (1 + np.exp(-(a + b * z)))
            g = np.array([(each * (r - y)).sum() + a, (each * (r - y) * z).sum() + b - 1])
            w = each * r * (1 - r)
            h = np.array([[w.sum() + 1, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(a), max(float(b), 0.05))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        """(score, evidence) of each text, by the text alone."""
        if len(self.known) > 2_000:
            self.known.clear()
        keys = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
        todo = {k: self.words.find(*terms(t)[:2]) for k, t in zip(keys, texts, strict=True) if k not in self.known}
        # texts that go together have like words, so that blocks are of use to all of them or to none
        vectors = sorted(((self._heaviest(at, w), at, w, k) for k, (at, n) in todo.items() for w in (self.words.unit(at, n),)), key=lambda x: x[0])
        for at in range(0, len(vectors), self.p.batch):
            part = vectors[at : at + self.p.batch]
            for (*_, key), (i, s) in zip(part, self.nearest([x[1:3] for x in part], self.p.k), strict=True):
                v = self.vote(i, s)
                z = self.curve[0] + self.curve[1] * np.log(v / (1 - v))
                top = range(min(self.p.evidence, len(i)))
                self.known[key] = (round(float(1 / (1 + np.exp(-z))), 9), [{"doc_id": int(self.ids[i[x]]), "similarity": float(s[x]), "label": int(self.labels[i[x]])} for x in top])
        return [self.known[k] for k in keys]


def _examples(docs: DataFrame, labels: DataFrame, scratch: Scratch, p: Params) -> tuple[DataFrame, float]:
    """(doc_id, y, hashes, counts, words) of at most p.examples rows of each class, a row per text; and the share of toxic
    rows among all labels to learn from."""
    known = scratch.save(learned(labels, "toxic"), "known")
    seen = known.agg(F.count("*"), F.sum("y")).first()
    chosen = scratch.save(bounded(known.where("y = 1"), p.examples).union(bounded(known.where("y = 0"), p.examples)), "chosen")
    # at most 2 * p.examples rows: a proven bound
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [terms(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([h.tobytes() for h, _, _ in found], pa.binary()), pa.array([n.tobytes() for _, n, _ in found], pa.binary()), pa.array([w for _, _, w in found], pa.int32())], ["doc_id", "y", "hashes", "counts", "words"])

    rows = rows.mapInArrow(lean(count), "doc_id long, y int, hashes binary, counts binary, words int")
    same = rows.groupBy("hashes", "counts", "words").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    return scratch.save(same, "examples"), (seen[1] or 0) / max(1, seen[0])


def _frequencies(docs: DataFrame, words) -> DataFrame:
    """(term, n): how many rows have each term of the broadcast vocabulary. A row per task and term is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(words.value.hashes), np.int64)
        for batch in batches:
            for text in batch.column(0):
                hashes, counts, _ = terms(text.as_py())
                seen[words.value.find(hashes, counts)[0]] += 1
        held = np.flatnonzero(seen)
        for at in range(0, len(held), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(held[at : at + 65536].astype(np.int32)), pa.array(seen[held[at : at + 65536]])], ["term", "n"])

    return docs.select("text").mapInArrow(lean(run, words), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Index | float:
    """The calibrated index, or the base rate where labels lack a class. The driver holds the examples (at most 2 *
    p.examples) and a count for each of their words, nothing else."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    table, share = _examples(docs, labels, scratch, p)
    held = table.orderBy("doc_id").toArrow()
    scratch.clear()
    y = np.array(held["y"].to_pylist(), np.int64)
    if not len(y) or not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    raw = [(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int32), w.as_py()) for h, n, w in zip(held["hashes"], held["counts"], held["words"], strict=True)]
    ids = held["doc_id"].to_numpy()
    del held
    words = learn(raw, y, p)
    rows = [words.find(h, n) for h, n, _ in raw]
    del raw
    sent = docs.sparkSession.sparkContext.broadcast(words)
    counted = _frequencies(docs, sent).toArrow()  # a row for each word of the examples at most
    sent.unpersist()
    found = np.zeros(len(words.hashes), np.int64)
    found[counted["term"].to_numpy()] = counted["n"].to_numpy()
    words.weigh(found, docs.count())
    rows = [(at, words.unit(at, n)) for at, n in rows]
    pick = np.argsort(ids * 2654435761 % (1 << 32), kind="stable")[: p.calibrate].tolist()
    sample = [(int(ids[i]), *rows[i]) for i in pick]
    index = Index(p, words, ids, y, rows)
    index.calibrate(sample, share)
    return index


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row of docs (doc_id, text); labels: (doc_id, toxic).

    Learns from labels that are not null and whose crc32(doc_id as text) mod 5 is not 0; a doc_id labelled both ways goes
    by its majority, texts of equal words count as one example. A score depends on the text alone: equal texts have equal
    scores, and texts without a word of any example (null and empty ones too) have no evidence and the score of a base rate
    without neighbours. evidence lists the nearest examples. A null doc_id is not held out. Without labels of both classes all
    scores are the base rate, 0.5 without any. An empty table gives none. Other columns are not read.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    made = fit(rows, labels, p)
    evidence = "array<struct<doc_id: long, similarity: double, label: int>>"
    if isinstance(made, float):
        scored = rows.select("doc_id", F.lit(made).alias("score"), F.array().cast(evidence).alias("evidence"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(made)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = sent.value.score(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kind)], ["doc_id", "score", "evidence"])

        scored = rows.mapInArrow(lean(judge, sent), f"doc_id long, score double, evidence {evidence}")
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs whose texts score() doesn't predict toxic, as they are: texts alone decide, so rows without a doc_id
    and rows that repeat are judged like others; null and empty texts have no evidence and stay where toxic rows are the fewer.
    Without labels of both classes nothing is judged and all stay. Columns keep names and types, whatever they are; nothing is joined or shuffled but small tables. An empty table gives none.
    """
    made = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, p)
    if isinstance(made, float):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(made)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 1024):
                part = batch.slice(x, 1024)
                yield part.filter(pa.array([s < 0.5 for s, _ in sent.value.score(part.column(at).cast(pa.string()).to_pylist())], pa.bool_()))

    return spread(docs).mapInArrow(lean(run, sent), docs.schema)
