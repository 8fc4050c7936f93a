"""Line dedup by a log-template tree, in DataFrame operations alone.

A line descends a tree of fixed depth: by its number of tokens, then by its leading tokens, in which fields with a digit
or an at sign are variable. In each leaf, positions at which most distinct lines agree are constant and the others
variable; lines that agree with most constants share the leaf's template, others are templates of their own. Templates
that recur across documents are dropped.

Copies of a document are no recurrence: near copies share nearly all lines, so what counts is how many classes of near
copies a template occurs in. Documents are near copies if most of either, by length, is lines that begin or end as one of the
other's; bands of MinHashes over how lines begin and end find whom to compare.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, components, free, small


@dataclass(frozen=True)
class Params:
    """depth: leading tokens that name a leaf. tokens: fewest of a line that can be dropped. docs: fewest documents, and
    fewest classes of near copies, across which a template recurs. sorts: least percentage of these classes among the
    documents; it keeps lines of a large group of near copies of which a few were taken for classes of their own. constant:
    percentage of a leaf's distinct lines that agree on a constant token. alike: percentage of a line's tokens that equal
    constants of its leaf's template. near: percentage of either's text, by length, that near copies share. bands, hashes: of
    MinHashes that find documents to compare."""

    depth: int = 3
    tokens: int = 4
    docs: int = 3
    sorts: int = 40
    constant: int = 50
    alike: int = 60
    near: int = 88
    bands: int = 16
    hashes: int = 3


#: A field with a digit or an at sign, anchored at its start so that no text makes the search slow; runs of blanks; what
#: needs either pattern.
_VARIABLE, _SPACE, _ODD = r"(^|[ \t\x0b-\r])[^ \t\x0b-\r0-9@]*+[0-9@][^ \t\x0b-\r]*+", r"[ \t\x0b-\r]+", r"[0-9@\t\x0b-\r]|  "
PRIME = (1 << 31) - 1


def factors(p: Params) -> list[tuple[int, int]]:
    """(a, b) of each MinHash (a * x + b) mod PRIME: a multiplicative generator's numbers, a under 2 ** 30 so that no product
    with 32 bits overflows."""
    out, x = [], 1
    for _ in range(p.bands * p.hashes):
        a = x = x * 48271 % PRIME
        b = x = x * 48271 % PRIME
        out.append((a >> 1 | 1, b))
    return out


def masked(line: Column) -> Column:
    """A line with single blanks between its tokens and <*> for variable fields."""
    plain = F.regexp_replace(F.regexp_replace(line, _VARIABLE, "$1<*>"), _SPACE, " ")
    return F.trim(F.when(line.rlike(_ODD), plain).otherwise(line))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _key(line: Column) -> Column:
    return F.substring(F.md5(line.cast("binary")), 1, 24)


def _number(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def _affine(a: int, b: int) -> Callable[[Column], Column]:
    return lambda x: (x * a + b) % PRIME


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """(row, at, line, tokens) of each line of docs (row, text) that has a token; line is masked, at its place."""
    # masked within the generator: filters on its output don't mask again
    out = docs.select("row", F.posexplode(F.transform(F.split("text", "\n"), lambda x: masked(x))).alias("at", "line")).where("line <> ''")
    return out.withColumn("tokens", _tokens(F.col("line")))


def _once(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of docs (row, text) for each row value. Only texts with copies are shuffled."""
    copied = scratch.save(docs.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "copied")
    several = docs.join(small(copied, 16), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    return docs.join(small(copied, 16), "row", "left_anti").union(several)


def _copies(found: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(row, sort) of the rows, with lines found (row, x, y, size), that have near copies; equal sorts are one class.

    In each bucket of a band, rows are compared with its least row alone, so that a large class costs no more pairs.
    """
    x = F.col("x")
    least = [F.min(_affine(a, b)(x)).alias(f"m{i}") for i, (a, b) in enumerate(factors(p))]
    hashed = found.select("row", F.explode(F.array("x", "y")).alias("x")).groupBy("row").agg(*least)
    hashed = hashed.select("row", F.array(*(f"m{i}" for i in range(len(least)))).alias("h"))
    band = F.array(*(F.struct(F.lit(k).alias("band"), *(F.col("h")[k * p.hashes + i].alias(f"h{i}") for i in range(p.hashes))) for k in range(p.bands)))
    bands = scratch.save(hashed.select("row", F.explode(band).alias("b")).select("row", "b.*"), "bands")
    on = [c for c in bands.columns if c != "row"]
    heads = scratch.save(bands.groupBy(*on).agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    pairs = bands.join(small(heads), on).where("row <> head").select("row", "head").distinct()
    pairs = scratch.save(pairs, "compared")
    scratch.drop("bands", "heads")
    # what of each row of a pair the other has
    two = scratch.save(pairs.select("row", F.col("head").alias("other")).union(pairs.select("head", "row")), "two")
    some = scratch.save(two.select("row").distinct(), "some")
    lines = scratch.save(found.join(small(some, 16), "row", "left_semi").select("row", "x", "y", "size"), "lines")
    starts, stops = (lines.select(F.col("row").alias("other"), c, F.lit(True).alias(f"same_{c}")).distinct() for c in ("x", "y"))
    seen = two.join(lines, "row").join(starts, ["other", "x"], "left").join(stops, ["other", "y"], "left")
    shared = seen.groupBy("row", "other").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("same_x") | F.col("same_y"), F.col("size")).otherwise(0)).alias("shared"))
    enough = shared.where(100 * F.col("shared") >= p.near * F.col("size"))
    links = enough.groupBy(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).agg(F.count("*").alias("n")).where("n = 2").select("a", "b")
    return scratch.save(components(links, scratch, "near").select(F.col("node").alias("row"), F.col("component").alias("sort")), "near")


def recurring(docs: DataFrame, scratch: Scratch, p: Params) -> tuple[DataFrame, DataFrame]:
    """Of docs (row, text): (row, at, key) of all lines of enough tokens, and (key, docs, sorts) of those whose templates
    recur. Rows with one text have one row, and count once."""
    start, end = _key(F.substring_index("line", " ", p.depth)), _key(F.substring_index("line", " ", -p.depth))
    found = _lines(_once(docs, scratch)).select("row", "at", _key(F.col("line")).alias("key"), "tokens", (F.length("line") + 1).alias("size"), start.alias("start"), _number(end).alias("y"))
    leaf = F.concat_ws(" ", F.col("tokens").cast("string"), "start")
    found = found.select("row", "at", "key", "tokens", "size", leaf.alias("leaf"), _number(F.col("start")).alias("x"), "y")
    found = scratch.save(found, "found")
    near = _copies(found, scratch, p)
    rows = found.where(F.col("tokens") >= p.tokens)
    sorted_ = rows.select("row", "key", "leaf").distinct().join(small(near, 32), "row", "left").select("row", "key", "leaf", F.coalesce("sort", "row").alias("sort"))
    # documents are counted by (line, class) before they meet, then classes by line
    stats = sorted_.groupBy("key", "leaf", "sort").agg(F.count("*").alias("docs"), F.min("row").alias("row"))
    stats = stats.groupBy("key", "leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("sorts"), F.min("row").alias("row"))
    stats = scratch.save(stats, "stats")
    leaves = stats.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).where((F.col("lines") > 1) & (F.col("docs") >= p.docs)).select("leaf", "lines")
    leaves = scratch.save(leaves, "leaves")

    # the distinct lines of leaves that may generalise, each read again from one document
    wanted = scratch.save(stats.join(small(leaves.select("leaf")), "leaf", "left_semi").select("row", "key", "leaf"), "wanted")
    again = scratch.save(wanted.select("row").distinct(), "again")
    again = _lines(docs.join(small(again, 16), "row", "left_semi")).where(F.col("tokens") > p.depth).select("row", _key(F.col("line")).alias("key"), "line")
    variants = again.join(wanted, ["row", "key"]).groupBy("leaf", "key").agg(F.min("line").alias("line"))
    variants = scratch.save(variants.select("leaf", "key", F.split("line", " ").alias("tokens")), "variants")
    votes = variants.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    votes = votes.join(leaves, "leaf").where(100 * F.col("n") >= p.constant * F.col("lines"))
    best = votes.groupBy("leaf", "at").agg(F.min(F.struct((-F.col("n")).alias("n"), "token"))["token"].alias("token"))
    template = best.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "token"))).alias("constants"))
    agreed = F.size(F.filter(F.transform("tokens", lambda t, i: F.try_element_at("constants", i) == t), lambda x: x))
    alike = variants.join(template, "leaf").where(100 * agreed >= p.alike * F.size("tokens")).select("key", "leaf")
    alike = scratch.save(alike, "alike")
    # a template's classes are those of all its lines, each once
    merged = sorted_.select("key", "sort").join(small(alike, 64), "key").groupBy("leaf", "sort").agg(F.count("*").alias("docs"))
    merged = merged.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("sorts"))
    enough = (F.col("docs") >= p.docs) & (F.col("sorts") >= p.docs) & (100 * F.col("sorts") >= p.sorts * F.col("docs"))
    shared = merged.where(enough).join(alike, "leaf").select("key", "docs", "sorts")
    single = stats.where(enough).join(small(alike.select("key")), "key", "left_anti").select("key", "docs", "sorts")
    gone = scratch.save(single.union(shared), "recurring")
    scratch.clear("found", "recurring")
    return rows.select("row", "at", "key"), gone


def drop_lines(docs: DataFrame, p: Params = Params(), counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """docs with counts (lines, and those dropped) added, and text without its recurring lines.

    A null text stays null and has no line; a text none of whose lines recurs stays as it is, byte for byte; one that
    consists of such lines becomes empty. Rows of equal texts count as one document and fare alike, whatever their other
    columns. Lines whose counts tie with a threshold are dropped. Needs text alone; other columns pass through, whatever their
    names, but for columns named as counts, which are replaced. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "linedup")
    row, same, gone_at, kept = free(docs, "row", "same", "gone", "kept")
    keyed = docs.withColumn(row, text_key(F.col("text")))
    rows, gone = recurring(keyed.where("text is not null").select(F.col(row).alias("row"), "text"), scratch, p)
    few = scratch.save(rows.join(small(gone.select("key")), "key", "left_semi").groupBy("row").agg(F.collect_list("at").alias("at")), "few")
    scratch.clear("few")
    few = small(few, 96)
    out = keyed.join(few.select(F.col("row").alias(same), F.col("at").alias(gone_at)), F.col(row) == F.col(same), "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone_at, i))
    out = out.withColumn(kept, F.when(F.col(gone_at).isNotNull(), lines))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    dropped = F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at)).cast("long")
    return out.withColumns({counts[0]: count, counts[1]: dropped, "text": F.coalesce(F.array_join(kept, "\n"), "text")}).drop(row, same, gone_at, kept)
