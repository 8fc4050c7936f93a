"""Embedding near-dedup: hierarchical navigable small-world graphs per shard.

Equal vectors of a block (label and dimension) become one representative with a count. Each block is cut into shards of a
bounded size; each shard gets a graph, kept as a file in the shared folder. For each two shards of a block, a task reads both
files, and each shard's graph answers the other's vectors; what either finds counts for both. A task audits its answers on
sampled queries against brute force and doubles the beam until recall passes; a query whose whole beam lies within the
threshold doubles its own beam. Beyond the widest beam the shard is scanned, so the number of partners has no cap.
Candidates are verified by cosine in double precision. A task returns a count a vector and a spanning forest, not its pairs,
so what travels grows with the vectors; forests unite components.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, components, file_system, small


@dataclass(frozen=True)
class Params:
    """shard: vectors of a graph, about. links, links0: of a node in upper layers and the lowest. beam: width while building
    and at first while searching; widest: the last before a shard is scanned. audit: queries with links that a search is
    audited on, out of at most eight times as many. recall: what an audit must find of the true links before beams stop
    widening."""

    cosine: float = 0.93
    shard: int = 8192
    links: int = 12
    links0: int = 20
    beam: int = 32
    widest: int = 256
    audit: int = 32
    recall: float = 0.995


class Graph:
    """A small-world graph over unit vectors; searches run for many queries in step."""

    def __init__(self, vectors: np.ndarray, p: Params):
        self.p, self.x, n = p, vectors, len(vectors)
        r = np.random.default_rng(n)
        order = r.permutation(n)
        self.level = np.minimum(-np.log(1 - r.random(n)) / np.log(p.links), 8).astype(int)
        self.level[order[:1]] = max(1, self.level.max(initial=0))
        self.near = [np.full((n, p.links0 if k == 0 else p.links), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry, done = int(order[0]) if n else -1, 1
        while done < n:  # batches that the graph so far is large enough to guide, closer ones among themselves included
            batch = order[done : done + int(np.clip(done // 2, 1, 256))]
            self._insert(batch)
            done += len(batch)

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, np.einsum("bkd,bd->bk", self.x[ids], q), -2).astype(np.float32)

    def _layer(self, q: np.ndarray, start: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and similarities [query, beam], best first; -1 and -2 where there are fewer."""
        ids = np.full((len(q), beam), -1, np.int64)
        width = min(beam, start.shape[1])
        ids[:, :width] = start[:, :width]
        sims = self._sims(q, ids)
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        rows = np.arange(len(q))
        seen[rows[:, None], ids] = True
        open_ = ids >= 0
        live = rows
        while len(live):
            at = np.where(open_[live], sims[live], -3).argmax(axis=1)
            go = open_[live, at]
            live, at = live[go], at[go]
            if not len(live):
                break
            open_[live, at] = False
            near = self.near[level][ids[live, at]].astype(np.int64)
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            s = self._sims(q[live], near)
            all_s = np.concatenate((sims[live], s), axis=1)
            pick = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), axis=1), pick, 1)
            sims[live] = np.take_along_axis(all_s, pick, 1)
            open_[live] = np.take_along_axis(np.concatenate((open_[live], near >= 0), axis=1), pick, 1) & (ids[live] >= 0)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _choose(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates, best first, those nearer to the base than to any chosen one; the rest fill up."""
        x = self.x[ids]
        between = x @ x.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        best = np.full(ids.shape, -2, np.float32)  # of each candidate to what is chosen
        for k in range(ids.shape[1]):
            yes = (ids[:, k] >= 0) & (best[:, k] <= sims[:, k]) & (taken.sum(axis=1) < m)
            taken[:, k] = yes
            best = np.where(yes[:, None], np.maximum(best, between[:, k]), best)
        rank = np.where(ids >= 0, np.where(taken, 0, 1), 2) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :m]
        return np.take_along_axis(ids, pick, 1)

    def _insert(self, batch: np.ndarray) -> None:
        q, start = self.x[batch], np.full((len(batch), 1), self.entry, np.int64)
        top = len(self.near) - 1
        among = q @ q.T
        for level in range(top, -1, -1):
            ids, sims = self._layer(q, start, self.p.beam if level <= self.level[batch].max() else 1, level)
            start = ids[:, : self.p.beam]
            here = np.flatnonzero(self.level[batch] >= level)
            if not len(here):
                continue
            inside = among[np.ix_(here, here)] - 3 * np.eye(len(here), dtype=np.float32)
            inside[np.triu_indices(len(here))] = -3  # earlier ones of the batch only
            k = min(self.p.beam // 4, len(here))
            best = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(inside, best, 1)
            c_ids = np.concatenate((ids[here], np.where(s > -1.5, batch[here][best], -1)), axis=1)
            c_sims = np.concatenate((sims[here], np.where(s > -1.5, s, -2)), axis=1)
            order = np.argsort(-c_sims, axis=1)[:, : self.p.beam]
            c_ids, c_sims = np.take_along_axis(c_ids, order, 1), np.take_along_axis(c_sims, order, 1)
            m = self.near[level].shape[1]
            chosen = self._choose(q[here], c_ids, c_sims, m // 2)
            self.near[level][batch[here], : chosen.shape[1]] = chosen
            self._back(np.repeat(batch[here], chosen.shape[1]), chosen.reshape(-1), level)

    def _back(self, source: np.ndarray, to: np.ndarray, level: int) -> None:
        """Links back; a full list is chosen anew from its own and the new ones."""
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        near = self.near[level]
        wide = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(begin, count)] = source
        held = (near[nodes] >= 0).sum(axis=1)
        easy = held + count <= near.shape[1]
        for k in np.flatnonzero(easy):
            near[nodes[k], held[k] : held[k] + count[k]] = wide[k, : count[k]]
        for at in range(0, len(hard := np.flatnonzero(~easy)), 512):
            part = hard[at : at + 512]
            ids = np.concatenate((near[nodes[part]].astype(np.int64), wide[part]), axis=1)
            sims = self._sims(self.x[nodes[part]], ids)
            order = np.argsort(-sims, axis=1)[:, : 3 * near.shape[1]]
            near[nodes[part]] = self._choose(self.x[nodes[part]], np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), near.shape[1])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry, np.int64)
        for level in range(len(self.near) - 1, 0, -1):
            start = self._layer(q, start, 4, level)[0]
        return self._layer(q, start, beam, 0)

    def within(self, q: np.ndarray, floor: float, own: bool = False) -> tuple[np.ndarray, float | None]:
        """(found, recall): found [query, node] is whether similarity >= floor, as far as the audited beams find it; recall is
        the audit's mean over sampled queries that have links, null if none has. own: queries are the nodes themselves, whose
        matches with themselves don't count."""
        n, found = len(self.x), np.zeros((len(q), len(self.x)), bool)
        sample = np.random.default_rng(len(q)).permutation(len(q))[: 8 * self.p.audit]
        true = q[sample] @ self.x.T >= floor
        if own:
            true[np.arange(len(sample)), sample] = False
        linked = np.flatnonzero(true.any(axis=1))[: self.p.audit]
        sample, true = sample[linked], true[linked]
        beam, recall = self.p.beam, None
        while len(sample):
            hit = np.zeros_like(true)
            for i, j in self._wide(q[sample], beam, floor):
                hit[i, j] = True
            recall = float(((hit & true).sum(axis=1) / true.sum(axis=1)).mean())
            if recall >= self.p.recall or beam >= min(n, 2 * self.p.widest):
                break
            beam *= 2
        for at in range(0, len(q), 512):
            for i, j in self._wide(q[at : at + 512], beam, floor):
                found[at + i, j] = True
        if own:
            np.fill_diagonal(found, False)
        return found, recall

    def _wide(self, q: np.ndarray, beam: int, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at a beam that queries double for themselves while all of it is within the floor."""
        todo = np.arange(len(q))
        while len(todo):
            if beam > self.p.widest or beam >= len(self.x):
                for at in range(0, len(todo), 256):
                    i, j = np.nonzero(q[todo[at : at + 256]] @ self.x.T >= floor)
                    yield todo[at : at + 256][i], j
                return
            ids, sims = self.search(q[todo], beam)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= floor)
            i, k = np.nonzero((sims >= floor) & ~full[:, None])
            yield todo[i], ids[i, k]
            todo, beam = todo[full], 2 * beam


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns): edges of a spanning forest of a two-sided graph, given as a matrix."""
    other, out = np.ascontiguousarray(hit.T), []
    new_row, new_column = hit.any(axis=1), hit.any(axis=0)
    for root in np.flatnonzero(new_row).tolist():
        if not new_row[root]:
            continue
        new_row[root], rows = False, [root]
        while rows:
            r = rows.pop()
            columns = np.flatnonzero(hit[r] & new_column)
            new_column[columns] = False
            for c in columns.tolist():
                out.append((r, c))
                more = np.flatnonzero(other[c] & new_row)
                new_row[more] = False
                out += [(x, c) for x in more.tolist()]
                rows += more.tolist()
    pairs = np.array(out, np.int64).reshape(len(out), 2)
    return pairs[:, 0], pairs[:, 1]


def comparable(vector: Column) -> Column:
    """Whether all components are finite and not null, and one is not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: list) -> np.ndarray:
    x = np.stack(vectors)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _confirmed(hit: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> None:
    """Leaves of hit [x, y] what has that cosine, in double precision."""
    for at in range(0, len(x), 256):
        part = hit[at : at + 256]
        i, j = np.nonzero(part)
        if 50 * len(i) > part.size:
            part &= x[at : at + 256] @ y.T >= cosine
        elif len(i):
            part[i, j] = np.einsum("nd,nd->n", x[at + i], y[j]) >= cosine


def _compare(one: tuple, two: tuple | None, p: Params) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray], float | None]:
    """Counts (nodes, linked vectors) and forest edges (a, b) between two shards (graph, unit vectors, nodes, copies), or
    within one, and the least recall that an audit found."""
    floor, (graph, x, mine, copies) = p.cosine - 1e-4, one
    if two is None:
        hit, recall = graph.within(x.astype(np.float32), floor, own=True)
        hit |= hit.T
        y, other, weights = x, mine, copies
    else:
        index, y, other, weights = two
        hit, recall = index.within(x.astype(np.float32), floor)
        back, second = graph.within(y.astype(np.float32), floor)
        hit |= back.T
        recall = min((r for r in (recall, second) if r is not None), default=None)
    _confirmed(hit, x, y, p.cosine)
    sums = lambda m, w: np.concatenate([m[at : at + 256] @ w.astype(np.float64) for at in range(0, len(m), 256)]).astype(np.int64)
    counts = [(mine, sums(hit, weights))] + ([(other, sums(hit.T, copies))] if two is not None else [])
    i, j = spanning(hit)
    return counts, (mine[i], other[j]), recall


#: Representatives without a vec_id of their own have a node above any vec_id.
NAMELESS = 1 << 62


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row of vectors (vec_id, embedding, label).

    Vectors link if labels are equal and not null, dimensions are equal and cosine in double precision is at least
    p.cosine; ties with it link. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    as do rows with a null vec_id. n_links counts other vec_ids; repeated rows of a vec_id share its links (a vec_id with
    several vectors has those of all). component_id is the smallest vec_id reachable. recall is the least that an audit of
    the label's searches found of true links before vectors were scanned, null where no sampled vector has one. An empty table
    gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string"))
    # an unambiguous text of the vector is its identity; -0.0 is 0.0
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("v")))
    key = F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))).cast("binary")))
    good = scratch.save(good.select("vec_id", "v", "label", F.size("v").alias("dim"), key.alias("key")), "good")
    groups = ["label", "dim", "key"]
    members = scratch.save(good.select("vec_id", *groups).distinct(), "members")
    several = scratch.save(members.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("vec_id").alias("rep"), F.lit(True).alias("several")), "several")
    reps = members.groupBy(*groups).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).join(small(several), "rep", "left")
    node = F.when(F.col("several"), F.lit(NAMELESS) + F.pmod(F.xxhash64(*groups), F.lit(1 << 61))).otherwise(F.col("rep"))
    reps = scratch.save(reps.select(*groups, "copies", node.alias("node")), "reps")
    blocks = scratch.save(reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / p.shard).cast("int").alias("shards")), "blocks")
    once = good.groupBy(*groups).agg(F.first("v").alias("v")).join(reps, groups).join(small(blocks), ["label", "dim"])
    dealt = once.select("label", "dim", "node", "copies", "v", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("own"))
    folder = scratch.path("graphs")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf["v"].tolist())
        files, at = file_system(folder)
        files.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{at}/{name}") as out:
            out.write(pickle.dumps((Graph(x.astype(np.float32), p), x, pdf["node"].to_numpy(), pdf["copies"].to_numpy())))
        return pdf.iloc[:1][["label", "dim", "own"]].assign(file=name)

    # a row a shard; a repeated task leaves a file that no row names
    shards = scratch.save(dealt.groupBy("label", "dim", "own").applyInPandas(build, "label string, dim int, own int, file string"), "shards")
    other = shards.select("label", "dim", F.col("own").alias("with"), F.col("file").alias("second"))
    tasks = scratch.save(shards.join(other, ["label", "dim"]).where("own <= with"), "tasks")
    tasks = tasks.repartition(max(1, min(tasks.count(), 100_000)))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = file_system(folder)

        def load(name: str) -> tuple:
            with files.open_input_stream(f"{at}/{name}") as f:
                return pickle.loads(f.read())

        for pdf in frames:
            for label, dim, one, two in zip(pdf["label"], pdf["dim"], pdf["file"], pdf["second"], strict=True):
                counts, (a, b), recall = _compare(load(one), None if one == two else load(two), p)
                for nodes, n in counts:
                    yield pd.DataFrame({"label": label, "dim": dim, "a": nodes[n > 0], "b": -1, "n": n[n > 0], "recall": None})
                yield pd.DataFrame({"label": label, "dim": dim, "a": a, "b": b, "n": 0, "recall": None})
                yield pd.DataFrame({"label": [label], "dim": [dim], "a": [-1], "b": [-1], "n": [-1], "recall": [recall]})

    found = scratch.save(tasks.select("label", "dim", "file", "second").mapInPandas(compare, "label string, dim int, a long, b long, n long, recall double"), "found")
    linked = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    audits = found.where("n < 0").groupBy("label").agg(F.min("recall").alias("recall"))
    edges = found.where("n = 0").select("a", "b")
    members = scratch.save(members.join(reps, groups).select("vec_id", "label", "node", "copies"), "placed")
    mixed = several.limit(1).count() > 0
    if mixed:  # a vec_id's vectors hang together
        edges = edges.union(members.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).where("a <> b").select("a", F.explode("all").alias("b")))
    joined = scratch.save(components(edges, scratch, "joined"), "joined")
    placed = members.join(linked, "node", "left").join(joined, "node", "left").join(small(scratch.save(audits, "audits")), "label", "left")
    placed = placed.select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"), "recall")
    if mixed:
        placed = scratch.save(placed, "mixed")
        placed = placed.drop("c").join(placed.select("vec_id", "c").join(placed.groupBy("c").agg(F.min("vec_id").alias("least")), "c").select("vec_id", F.col("least").alias("c")).distinct(), "vec_id")
        placed = placed.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"), F.min("recall").alias("recall"))
    placed = scratch.save(placed, "result")
    scratch.clear("result")
    scratch.remove("graphs")
    out = rows.select("vec_id").join(placed, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), "recall")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")
