"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is pre-tokenised in overlapping chunks. A pre-token's extent depends on the text from its start alone, so once
two neighbours share a boundary they agree from there: chunks are stitched at the first such boundary, and the pieces
between boundaries are encoded. Neighbours that never agree within an overlap are pre-tokenised together. Texts above a size
are dealt out first, in overlapping parts that are stitched the same way: parts find their boundaries in parallel, only those
near the overlaps travel, what lies between stitches is encoded in parallel, and ids are joined in order. Decoding
concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, lean, spread


@dataclass(frozen=True)
class Params:
    """ranks: a rank file (base64 token, rank); pattern: of pre-tokens, without lookbehind. chunk: characters of a chunk;
    overlap: characters it goes on into the next. unsure: last boundaries of a chunk that more text might move. part:
    characters from which a text is dealt out, and of a part. known: pre-tokens whose ids a task remembers. together:
    characters of texts that are merged together."""

    ranks: str
    pattern: str
    chunk: int = 4096
    overlap: int = 256
    unsure: int = 3
    part: int = 32768
    known: int = 200_000
    together: int = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Known:
    """Ids of pre-tokens, as bytes of 32-bit numbers, merged when first asked for, those that are new together. Of those of up
    to 64 characters, the size last met are remembered, twice as many at most: the generation before the last goes."""

    def __init__(self, merge: Callable[[list[bytes]], list[bytes]], size: int):
        self.merge, self.size, self.now, self.old = merge, size, {}, {}

    def forget(self) -> None:
        self.now, self.old = {}, {}

    def ids(self, texts: list[list[str]]) -> list[list[int]]:
        """Of texts as pre-tokens."""
        if len(self.now) >= self.size:
            self.now, self.old = {}, self.now
        new = []
        for piece in set(chain.from_iterable(texts)).difference(self.now):
            if (ids := self.old.get(piece)) is not None:
                self.now[piece] = ids
            else:
                new.append(piece)
        self.now.update(zip(new, self.merge([x.encode() for x in new]), strict=True))
        out = [np.frombuffer(b"".join(map(self.now.__getitem__, pieces)), np.int32).tolist() for pieces in texts]
        for piece in new:
            if len(piece) > 64:
                del self.now[piece]
        return out


class Pairs:
    """Merges many pre-tokens at once: each round merges one pair of every pre-token, its lowest-ranked, the left of equals.

    Pre-tokens are columns of a matrix. keys: left * most + right of all pairs whose union is a token; values: its rank.
    """

    #: Bytes of a pre-token at most, so that a place takes BITS; columns of a matrix.
    MOST, BITS, COLUMNS = 64, 6, 2048

    def __init__(self, ranks: dict[bytes, int]):
        self.most = max(ranks.values(), default=0) + 1
        self.kind, self.none = (np.int32, 1 << 24) if self.most <= 1 << 24 else (np.int64, 1 << 40)  # none: beyond all ranks
        found = [(a * self.most + b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.values = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], self.none).astype(self.kind)
        self.byte = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.most + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], self.kind(self.none))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of the pieces, of 1 to MOST bytes."""
        out, size = [b""] * len(pieces), np.fromiter(map(len, pieces), np.int32, len(pieces))
        order = np.argsort(size, kind="stable")
        for x in range(0, len(pieces), self.COLUMNS):
            self._columns(pieces, order[x : x + self.COLUMNS], size, out)
        return out

    def _columns(self, pieces: list[bytes], at: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        size = size[at]
        width, none = int(size.max()), self.kind(self.none << self.BITS)
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in at.tolist()]), np.uint8).reshape(len(at), width).T
        ids, places = self.byte[raw], np.arange(width, dtype=self.kind)[:, None]
        # of each pair: its rank, then its place, so that a minimum is the left of the lowest-ranked; a last row of none. What
        # is none stays so however often it moves up a place
        nothing = none + self.kind(self.MOST)
        pairs = np.full((width, len(at)), nothing)
        pairs[:-1] = np.where(places[1:] < size, self.first[raw[:-1] * np.int32(256) + raw[1:]] << self.BITS | places[:-1], nothing)
        pairs[pairs >= none] = nothing
        while True:
            least = pairs.min(axis=0)
            live = np.flatnonzero(least < none)
            if len(live) < len(at):
                done = np.flatnonzero(least >= none)
                rows, step = ids[:, done].T.tobytes(), 4 * len(ids)
                for k, i, n in zip(range(0, len(rows), step), at[done].tolist(), size[done].tolist(), strict=True):
                    out[i] = rows[k : k + 4 * n]
                if not len(live):
                    return
                at, size, least, ids, pairs = at[live], size[live], least[live], ids[:, live], pairs[:, live]
            size = size - 1
            place, merged, column = least & ((1 << self.BITS) - 1), least >> self.BITS, np.arange(len(at))
            after = places[: len(ids) - 1] > place
            ids, pairs = np.where(after, ids[1:], ids[:-1]), np.where(after, pairs[1:] - 1, pairs[:-1])
            ids[place, column] = merged
            pairs[-1] = nothing
            pairs[place, column] = nothing
            has_right, has_left = np.flatnonzero(place + 1 < size), np.flatnonzero(place > 0)
            right, left = place[has_right], place[has_left] - 1
            ranks = self.rank(np.concatenate((merged[has_right], ids[left, has_left])), np.concatenate((ids[right + 1, has_right], merged[has_left])))
            where, which = np.concatenate((right, left)), np.concatenate((has_right, has_left))
            pairs[where, which] = np.where(ranks < self.none, ranks << self.BITS | where, nothing)


class Codec:
    """Encodes and decodes with one rank file."""

    def __init__(self, p: Params):
        self.p, self.ranks, self.split = p, load_ranks(p.ranks), regex.compile(p.pattern)
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.pairs, self.known = Pairs(self.ranks), Known(self.merge_all, p.known // 2)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of each of the pieces, as bytes of 32-bit numbers; many short ones go together."""
        out = [array("i", self.merge(x)).tobytes() if x in self.ranks or len(x) > Pairs.MOST else b"" for x in pieces]
        rest = [i for i, ids in enumerate(out) if not ids]
        # fewer don't pay for the rounds
        found = self.pairs.merge([pieces[i] for i in rest]) if len(rest) >= 200 else [array("i", self.merge(pieces[i])).tobytes() for i in rest]
        for i, ids in zip(rest, found, strict=True):
            out[i] = ids
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the lowest-ranked neighbours merge first, the left of equals first.

        Short pieces are searched for the least rank, long ones keep a heap over a linked list: O(n log n) however long the
        piece is.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        n, ranks = len(piece), self.ranks
        if n <= 64:
            return self._merge_short(piece)
        after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        get, none = self.ranks.get, len(self.ranks) + (1 << 30)
        at = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[at[i] : at[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
        return tuple([self.ranks[piece[a:b]] for a, b in zip(at, at[1:], strict=False)])

    def found(self, text: str) -> list[str] | None:
        """Pre-tokens of a text by one search; None if something lies between them."""
        found = [] if self.split.groups else self.split.findall(text)
        return found if sum(map(len, found)) == len(text) else None

    def starts(self, text: str) -> list[int]:
        """Starts of the pre-tokens of a text, and its end, by one search."""
        if (found := self.found(text)) is not None:
            return [0, *accumulate(map(len, found))]
        return [m.start() for m in self.split.finditer(text)] + [len(text)]

    def boundaries(self, text: str) -> list[int]:
        """starts() by chunks."""
        size, over, n = self.p.chunk, self.p.overlap, len(text)
        if n <= size + over:
            return self.starts(text)
        found, near = [], []
        for begin in range(0, n, size):
            chunk = [begin + b for b in self.starts(text[begin : begin + size + over])]
            sure = chunk[: -self.p.unsure] if begin + size + over < n else chunk
            found.append(sure)
            near.append((begin, [b for b in sure if b <= begin + over], [b for b in sure if b >= begin + size]))
        placed = stitch(near)
        firsts = [k for k, (group, _) in enumerate(placed) if group == k]
        out = []
        for k, after in zip(firsts, [*firsts[1:], None], strict=True):
            begin, stop = placed[k][1], n if after is None else placed[after][1]
            # chunks that didn't agree are searched together; a chunk may know sure boundaries beyond its group's end
            own = found[k] if after == k + 1 or after is None and k == len(placed) - 1 else [begin + b for b in self.starts(text[begin:stop])]
            out += [b for b in own if begin <= b < stop]
        return [*out, n]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        found = self.found(text) if len(text) <= self.p.chunk + self.p.overlap else None
        if found is None:
            at = self.boundaries(text)
            found = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        return found

    def encode(self, text: str) -> list[int]:
        return self.known.ids([self.pieces(text)])[0]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """encode() of each text; texts of p.together characters share a look at what is known."""
        held, size = [], 0
        for text in texts:
            held.append(self.pieces(text))
            size += len(text)
            if size >= self.p.together:
                yield from self.known.ids(held)
                held, size = [], 0
        yield from self.known.ids(held)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(p: Params) -> Codec:
    return Codec(p)


def stitch(chunks: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int]]:
    """(group, start) of each chunk, in order: its group's first chunk, and where in the text the group's pieces begin.

    chunks: (begin, head, tail): a chunk's place and its sure boundaries, as places in the text, in its own overlap with
    the chunk before and in that with the chunk after. A chunk without a boundary in common joins the group before.
    """
    out = [(0, 0)]
    for k in range(1, len(chunks)):
        start = out[-1][1]
        # the one before counts from where it agrees with the text's own boundaries, which is its start if it leads a group
        sure = [b for b in chunks[k - 1][2] if b >= start] if out[-1][0] == k - 1 else []
        common = sorted(set(sure) & set(chunks[k][1]))
        out.append((k, common[0]) if common else out[-1])
    return out


_OUT = "doc_id long, text_key binary, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def _digest(ids: list[int], decoded: bytes) -> tuple[str, str]:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _short(docs: DataFrame, p: Params, keep_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for ids in c.encode_all(part.column(2).to_pylist()):
                    made.append((len(ids), ids if keep_ids else None, *_digest(ids, c.decode(ids))))
                n, ids, a, b = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(a), pa.array(b)], ["doc_id", "text_key", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        c.known.forget()  # the worker goes on to other stages

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), _OUT)


def _long(docs: DataFrame, p: Params, keep_ids: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "bpe")
    key = ["doc_id", "text_key"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                for k, begin in enumerate(range(0, len(text), p.part)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([k], pa.int32()), pa.array([begin], pa.int64()), pa.array([text[begin : begin + p.part + p.overlap]])], ["doc_id", "text_key", "k", "begin", "chunk"])

    once = docs.groupBy(*key).agg(F.first("text").alias("text"))
    chunks = scratch.save(once.mapInArrow(lean(cut), "doc_id long, text_key binary, k int, begin long, chunk string").repartition(*key, "k"), "chunks")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, c = [], [], codec(p)
            for begin, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                sure = c.boundaries(text)[: -p.unsure]
                heads.append([begin + b for b in sure if b <= p.overlap])
                tails.append([begin + b for b in sure if b >= p.part])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in range(4)), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["doc_id", "text_key", "k", "begin", "head", "tail"])

    near = chunks.mapInArrow(lean(edges), "doc_id long, text_key binary, k int, begin long, head array<long>, tail array<long>")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        placed = stitch([(b, list(h), list(t)) for b, h, t in zip(pdf["begin"], pdf["head"], pdf["tail"], strict=True)])
        out = pdf[["doc_id", "text_key", "k"]].assign(group=[g for g, _ in placed], start=[s for _, s in placed])
        # a group ends where the next begins
        nexts = {g: s for g, s in placed}
        order = sorted(nexts)
        stops = dict(zip(order, [*(nexts[g] for g in order[1:]), -1], strict=True))
        return out.assign(stop=[stops[g] for g in out["group"]])

    placed = near.groupBy(*key).applyInPandas(place, "doc_id long, text_key binary, k int, group int, start long, stop long")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text")) & (F.col("k") == F.col("_k"))
    joined = chunks.join(placed.withColumnsRenamed({"doc_id": "_doc", "text_key": "_text", "k": "_k"}), same).drop("_doc", "_text", "_k")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, c = pdf.sort_values("k"), codec(p)
        begin = int(pdf["begin"].iloc[0])
        text = "".join([*(x[: p.part] for x in pdf["chunk"].iloc[:-1]), pdf["chunk"].iloc[-1]])
        start, stop = int(pdf["start"].iloc[0]), int(pdf["stop"].iloc[0])
        ids = c.encode(text[start - begin : None if stop < 0 else stop - begin])
        row = pdf.iloc[:1][["doc_id", "text_key", "group"]].assign(part_ids=[ids], decoded=[c.decode(ids)])
        return row

    parts = joined.groupBy(*key, "group").applyInPandas(encode, "doc_id long, text_key binary, group int, part_ids array<int>, decoded binary")
    parts = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("group", "part_ids", F.hex("decoded").alias("decoded")))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda x: x["part_ids"]))
    decoded = F.unhex(F.array_join(F.transform("parts", lambda x: x["decoded"]), ""))
    joined_ids = F.encode(F.array_join(ids.cast("array<string>"), ","), "UTF-8")
    return parts.select(*key, F.size(ids).cast("long").alias("n_tokens"), (ids if keep_ids else F.lit(None).cast("array<int>")).alias("ids"), F.sha2(joined_ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def encode(docs: DataFrame, p: Params, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) per row of docs (doc_id, text); a null text is an empty one.

    ids are null unless keep_ids. Repeated long rows of one doc_id and text are encoded once and repeated. Null doc_ids are
    kept. An empty table gives none. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longer = F.char_length("text") > p.part
    docs = docs.withColumn("text_key", F.when(longer, F.unhex(F.md5(F.col("text").cast("binary")))))
    short = _short(spread(docs.where(~longer)), p, keep_ids)
    big = docs.where(longer)
    found = _long(big, p, keep_ids).withColumnsRenamed({"doc_id": "_doc", "text_key": "_text"})
    rows = big.select("doc_id", "text_key").join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))).drop("_doc", "_text")
    return short.unionByName(rows).drop("text_key")
