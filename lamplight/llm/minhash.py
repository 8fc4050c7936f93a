"""MinHash near-dedup with sequential Bayesian verification.

Each document's whole set of word shingles gives a digest and a signature, where the text lies. Equal sets become one
representative. Representatives that share a band are compared by signature batches: after each batch, a pair is pruned
if the posterior probability that its similarity reaches the threshold falls below the chosen miss probability. What
survives is verified exactly, on full sets.

Only components matter, so pairs of one component need no look. In each bucket all are compared with its head first; what
that leaves apart (the rest) is compared with the whole bucket, in pairs of bounded blocks. Exact verification goes the same
way: first the edges that survived, then, in components that fall apart, the rest against the whole. A group of n near
copies costs O(n) rows, a rest of m of them another m * n / block, and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, components, free, lean, small, spread

PIECE = 1 << 19  #: bytes hashed at once
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Params:
    """percent: links have 100 * intersection >= percent * union. words: of a shingle. hashes: of a signature. rows: of a
    band. batch: hashes compared between two looks at the posterior. miss: largest chance to prune a pair that links.
    block: members of a block of signatures; set_block: of sets."""

    percent: int = 80
    words: int = 5
    hashes: int = 128
    rows: int = 5
    batch: int = 16
    miss: float = 1e-6
    block: int = 512
    set_block: int = 192


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_MULT, PIECE + 1), _powers(pow(_MULT, -1, 1 << 64), PIECE + 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long_word(data: bytes) -> int:
    """The unmixed hash of one word longer than a piece."""
    total = 0
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at)
        total = (total + pow(_MULT, at, 1 << 64) * int((_LOWER[b] * _POW[: len(b)]).sum(dtype=np.uint64))) & _MASK
    return total


def word_hashes(data: bytes, space: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash and start of each word of UTF-8 bytes, A-Z in lower case, piece by piece; then, for each n of heads, hashes of the
    first n bytes of the words that are longer. space marks the bytes between words, [\\x20\\x09-\\x0D] by default."""
    found, starts, begun, at = [], [], [[] for _ in heads], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        piece = np.frombuffer(data, np.uint8, end - at, at)
        gap = space[piece]
        if end < len(data):
            if not gap.any():
                stop = end
                while stop < len(data) and not space[data[stop]]:
                    stop += 1
                found.append(np.array([_long_word(data[at:stop])], dtype=np.uint64))
                starts.append(np.array([at]))
                for n, out in zip(heads, begun, strict=True):
                    out.append(np.array([_long_word(data[at : at + n])], dtype=np.uint64))
                at = stop
                continue
            keep = len(piece) - int(gap[::-1].argmax())
            end, piece, gap = at + keep, piece[:keep], gap[:keep]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[piece] * _POW[: len(piece)], dtype=np.uint64)))
        found.append((total[last] - total[first]) * _INV[first])
        starts.append(first + at)
        for n, out in zip(heads, begun, strict=True):
            more = first[last - first > n]
            out.append((total[more + n] - total[more]) * _INV[more])
        at = end
    if not found:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in heads))
    return (_mix(np.concatenate(found)), np.concatenate(starts), *(_mix(np.concatenate(x)) + np.uint64(n) for n, x in zip(heads, begun, strict=True)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(k, len(words))
    total = np.full(len(words) - n + 1, 0 if n == k else n, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(_MULT) + words[j : len(words) - n + 1 + j]
    return np.unique(_mix(total))


def document_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text; short texts are hashed together, up to a piece at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size + len(texts[end] or b"") < PIECE or end == at):
            size += len(texts[end] or b"") + 1
            end += 1
        part = [x or b"" for x in texts[at:end]]
        words, starts = word_hashes(part[0] if len(part) == 1 else b" ".join(part))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in part)]))
        for i in range(len(part)):
            yield shingles(words[cuts[i] : cuts[i + 1]], k)
        at = end


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, out = (found >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        v = a[:, None] * x[None, at : at + 2048]
        v += b[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def sign(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, sig) per row; digest and sig are null for an empty set. Whole texts, no shuffle
    but for small tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(p.hashes)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                n, digests, sigs = [], [], []
                for s in document_sets(texts.slice(at, 512).to_pylist(), p.words):
                    n.append(len(s))
                    digests.append(_digest(s))
                    sigs.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), batch.column(1).slice(at, 512), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "sig"])

    rows = spread(docs.select(F.col("doc_id").cast("long"), text_key(docs).alias("text_key"), F.col("text").cast("string")))
    return rows.mapInArrow(lean(run), "doc_id long, text_key binary, n_shingles long, digest binary, sig binary")


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def text_key(docs: DataFrame):
    """128 bits of a text, an empty one's for null."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def bands(reps: DataFrame, p: Params) -> DataFrame:
    """(band, rep): a 64-bit key for each band of each signature."""
    width = p.hashes // p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), -1)[:, : width * p.rows].reshape(len(ids), width, p.rows)
            key = np.broadcast_to(_mix(np.arange(1, width + 1, dtype=np.uint64)), (len(ids), width))
            for r in range(p.rows):
                key = _mix(key * np.uint64(_MULT) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, width))], ["band", "rep"])

    return reps.select("rep", "sig").mapInArrow(lean(run), "band long, rep long")


def least_matches(p: Params) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to go on) after each batch.

    With a uniform prior, the posterior of the similarity after m matches of k is Beta(m + 1, k - m + 1), and
    P(similarity >= t) = P(Binomial(k + 1, t) <= m).
    """
    out, t = [], p.percent / 100
    for k in range(p.batch, p.hashes + 1, p.batch):
        total, m = 0.0, 0
        while m < k and (total := total + comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)) < p.miss:
            m += 1
        out.append((k, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows that no batch prunes."""
    seen, looks = np.zeros((len(left), len(right)), np.uint8), least_matches(p)
    for c in range(looks[0][0]):
        seen += left[:, c][:, None] == right[None, :, c]
    i, j = np.nonzero(seen >= looks[0][1])
    m = seen[i, j].astype(np.int32)
    for (at, _), (k, least) in zip(looks, looks[1:], strict=False):
        parts = [m[x : x + 65536] + (left[i[x : x + 65536], at:k] == right[j[x : x + 65536], at:k]).sum(axis=1) for x in range(0, len(i), 65536)]
        m = np.concatenate(parts) if parts else m
        keep = m >= least
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on n nodes."""
    if len(i) <= 1:
        return list(zip(i.tolist(), j.tolist(), strict=True))
    a, b = np.concatenate((i, j)), np.concatenate((j, i))
    order = np.argsort(a, kind="stable")
    b, begin = b[order], np.searchsorted(a[order], np.arange(n + 1))
    seen, out = np.zeros(n, bool), []
    for root in np.unique(a).tolist():
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            x = stack.pop()
            near = np.unique(b[begin[x] : begin[x + 1]])
            near = near[~seen[near]]
            seen[near] = True
            out += [(x, y) for y in near.tolist()]
            stack += near.tolist()
    return out


def rest_blocks(members: DataFrame, group: str, member: str, part: str, block: int) -> DataFrame:
    """Deals groups that fall into several parts to tasks (group, i, j): block i of the rest, which is all but the largest
    part, has rest = true, and block j of the whole group has rest = false. Other columns go along."""
    sizes = members.groupBy(group, part).agg(F.count("*").alias("_k"))
    largest = sizes.groupBy(group).agg(F.max(F.struct("_k", part)).alias("_m"), F.sum("_k").alias("_n"), F.count("*").alias("_parts")).where("_parts > 1")
    largest = largest.select(group, F.col(f"_m.{part}").alias("_main"), F.ceil(F.col("_n") / block).cast("int").alias("_whole"), F.ceil((F.col("_n") - F.col("_m._k")) / block).cast("int").alias("_rest"))
    rows = members.join(largest, group)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(member), F.col(n)).cast("int")
    apart = rows.where(F.col(part) != F.col("_main")).select("*", own("_rest").alias("i"), blocks("_whole").alias("j"), F.lit(True).alias("rest"))
    whole = rows.select("*", blocks("_rest").alias("i"), own("_whole").alias("j"), F.lit(False).alias("rest"))
    return apart.union(whole).drop("_main", "_whole", "_rest")


def _between(pdf: pd.DataFrame, pairs: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Runs pairs(left rows, right rows) on a task's rest and block, and returns a forest of (a, b)."""
    side = pdf["rest"].to_numpy()
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    ids, node = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
    i, j = pairs(left, right)
    i, j = node[left[i]], node[right[j]]
    links = forest(len(ids), i[i != j], j[i != j])
    return pd.DataFrame({"a": ids[[x for x, _ in links]], "b": ids[[y for _, y in links]]}, dtype="int64")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left and right sets, by products of 0/1 slices of their incidence matrix."""
    values, column = np.unique(np.concatenate([sets[x] for x in [*left, *right]]), return_inverse=True)
    shared = np.zeros((len(left), len(right)), np.float64)
    sizes = np.array([len(sets[x]) for x in [*left, *right]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    count = np.bincount(column, minlength=len(values))
    keep = count[column] > 1  # a value of one set is in no intersection
    row, column = row[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    for at in range(0, int((count > 1).sum()), 4096):
        x, y = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sizes), 4096), np.float32)
        part[row[x:y], column[x:y] - at] = 1
        shared += part[: len(left)] @ part[len(left) :].T
    return shared.astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (left[i], right[j]) of sets that are alike."""
    if 20 * len(i) > len(left) * len(right):
        size = np.array([len(x) for x in sets])
        shared = intersections(sets, left, right)[i, j]
        yes = 100 * shared >= percent * (size[left[i]] + size[right[j]] - shared)
    else:
        yes = np.array([alike(sets[left[x]], sets[right[y]], percent) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
    return i[yes], j[yes]


#: Representatives without a doc_id of their own have a node above any doc_id.
NAMELESS = 1 << 62


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), -1)


def _candidates(reps: DataFrame, scratch: Scratch, p: Params) -> tuple[DataFrame, DataFrame]:
    """(a, b): edges between representatives (rep, sig) that share a band and no batch prunes; their components are those of
    all such pairs. And these components."""
    banded = bands(reps, p)
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("head"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.hash("rep", F.lit(1)).cast("long") * F.hash(F.lit(2), "rep").cast("long")).alias("y")).where("n > 1")
    # bands with the same members need one look
    buckets = scratch.save(buckets.groupBy("n", "head", "hi", "x", "y").agg(F.min("band").alias("band")).select("band", "head"), "buckets")
    members = scratch.save(banded.join(small(buckets), "band"), "members")
    sigs = reps.select("rep", "sig")

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(p)
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(c).to_pylist()) for c in ("x", "y"))
                seen = np.cumsum(x == y, axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(np.logical_and.reduce([seen[:, k - 1] >= m for k, m in least])))

    stars = members.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sigs.withColumnsRenamed({"rep": "a", "sig": "x"}), "a").join(sigs.withColumnsRenamed({"rep": "b", "sig": "y"}), "b")
    near = scratch.save(stars.select("a", "b", "x", "y").mapInArrow(lean(looks), "a long, b long"), "near")
    parts = components(near, scratch, "stars")
    parts = members.select("band", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("part"))
    tasks = rest_blocks(scratch.save(parts, "parts"), "band", "rep", "part", p.block)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = _matrix(pdf["sig"].tolist())
        return _between(pdf, lambda left, right: survivors(sig[left], sig[right], p))

    more = tasks.select("band", "rep", "i", "j", "rest").join(sigs, "rep").groupBy("band", "i", "j").applyInPandas(bucket, "a long, b long")
    edges = scratch.save(near.union(more.distinct()), "edges")
    found = scratch.save(components(edges, scratch, "close"), "candidates")
    scratch.drop("buckets", "members", "near", "parts")
    return edges, found


def _sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(rep, set) of the digests wanted (digest, rep), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                found = list(document_sets(texts.slice(at, 512).to_pylist(), p.words))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["digest", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    named = wanted.where(F.col("rep") < NAMELESS).select(F.col("rep").alias("_id"))
    if wanted.where(F.col("rep") >= NAMELESS).limit(1).count():  # an odd table: all texts are looked through
        held = rows.select("text")
    else:
        held = rows.join(small(named), "_id", "left_semi").select("text")
    found = held.distinct().mapInArrow(lean(run), "digest binary, set array<long>")
    return scratch.save(found.join(small(wanted, 24), "digest").groupBy("rep", "digest").agg(F.first("set").alias("set")).select("rep", "set"), "sets")


def _groups(docs: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, component_id) of each row of docs; node is null for an empty set, else the least
    representative reachable by links, and component_id the least doc_id."""
    signed = scratch.save(sign(docs, p), "signed")
    reps = scratch.save(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")
    # doc_ids with several texts name none of them
    several = scratch.save(reps.where("rep is not null").groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.lit(True).alias("several")), "several")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("digest"), F.lit(1 << 61))
    reps = reps.join(small(several), "rep", "left").withColumn("rep", F.when(F.col("several") | F.col("rep").isNull(), nameless).otherwise(F.col("rep"))).drop("several")
    reps = scratch.save(reps, "named")
    edges, found = _candidates(reps.select("rep", "sig"), scratch, p)
    wanted = scratch.save(reps.select("digest", "rep").join(small(found.select(F.col("node").alias("rep"))), "rep", "left_semi"), "wanted")
    sets = _sets(docs, wanted, scratch, p)

    both = edges.distinct().join(sets.withColumnsRenamed({"rep": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "set": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = both.where(100 * shared >= p.percent * (F.size("x") + F.size("y") - shared)).select("a", "b")
    links = scratch.save(links, "links")
    parts = found.join(components(links, scratch, "verified").withColumnsRenamed({"component": "part"}), "node", "left")
    parts = scratch.save(parts.select("component", F.col("node").alias("rep"), F.coalesce("part", "node").alias("part")), "parts")
    tasks = rest_blocks(parts, "component", "rep", "part", p.set_block)

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, sig = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["set"]], _matrix(pdf["sig"].tolist())
        return _between(pdf, lambda left, right: verified(sets, left, right, *survivors(sig[left], sig[right], p), p.percent))

    a, b = _factors(p.hashes)

    def resign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("sig", pa.array([signature(x.values.to_numpy(zero_copy_only=False).view(np.uint64), a, b).tobytes() for x in batch.column(1)], pa.binary()))

    apart = parts.join(parts.where("part <> component").select("component").distinct(), "component", "left_semi").select("rep").distinct()
    signed_sets = sets.join(small(scratch.save(apart, "apart")), "rep", "left_semi").mapInArrow(lean(resign), "rep long, set array<long>, sig binary")
    more = tasks.select("component", "rep", "i", "j", "rest").join(signed_sets, "rep").groupBy("component", "i", "j").applyInPandas(rest, "a long, b long")
    final = scratch.save(components(links.union(more), scratch, "final"), "final")
    named = reps.select("digest", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("node"))
    out = scratch.save(signed.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left").drop("digest"), "rows")
    if several.limit(1).count():
        out = out.join(out.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("component_id")), "node", "left")
    else:
        out = out.withColumn("component_id", F.when(F.col("node") < NAMELESS, F.col("node")))
    scratch.clear("rows")
    return out.select("doc_id", "text_key", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Texts that are null or have no word have no set and link with nothing; texts with fewer words than a shingle have
    their whole sequence. Similarities that tie with the threshold link. component_id is the smallest doc_id reachable by
    links, kept marks that document. Rows of one doc_id with different texts are documents of their own with that id; equal rows
    share a result. Rows with a null doc_id are members like any other but never give a component its id, which is null if
    there is no other; they are kept only then. An empty table gives none. Other columns are not read.
    """
    groups = _groups(docs, Scratch(docs.sparkSession, "minhash"), p)
    return groups.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id (null last), then of the least hash
    of its text; of rows that repeat both, one. Rows without words stay, whatever their doc_id. An empty table gives none.
    Columns keep names and types, whatever they are. Texts are shuffled only where the rows that go are too many to broadcast.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    groups = _groups(docs, scratch, p).where("node is not null")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    # a group's rows are counted by (group, row) before they meet
    each = groups.groupBy("node", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = each.groupBy("node").agg(F.min(row).alias("first"), F.sum("n").alias("n")).where("n > 1").select("node", "first")
    each = scratch.save(each.join(first, "node").withColumn("stays", row == F.col("first")), "each")
    scratch.clear("each")
    _id, key, other_id, other_key, place = free(docs, "id", "key", "other_id", "other_key", "place")
    keyed = docs.withColumns({_id: F.col("doc_id").cast("long"), key: text_key(docs)})
    same = F.col(_id).eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))
    rows = lambda name, test: small(scratch.save(each.where(test).select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_key)).distinct(), name), 24)
    left = keyed.join(rows("gone", "not stays"), same, "left_anti")
    again = scratch.save(each.where("stays and n > 1").select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_key)).distinct(), "again")
    if not again.limit(1).count():
        return left.select(docs.columns)
    # rows that repeat: numbered by their place in the table, which splits a group of any size
    twice = scratch.save(left.join(small(again, 24), same, "left_semi").withColumn(place, F.monotonically_increasing_id()), "twice")
    firsts = scratch.save(twice.groupBy(_id, key).agg(F.min(place).alias(place)).select(place), "firsts")
    once = twice.join(firsts, place, "left_semi")
    return left.join(small(again, 24), same, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
