"""TEI documents: writing them from lines and rows, tolerant reading, transcripts with offsets and mentions, rewriting.

What is written from columns (build, synthesize) is string building in the JVM. What reads a tree works on one document at
a time in Arrow batches, so nothing of it shuffles; a document that can't be parsed is a row with its error.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamplight.functions.text import classify_line, lines, marker_label, page_ref

# Fixed values.
TEI_NS, XML_ID = "http://www.tei-c.org/ns/1.0", "{http://www.w3.org/XML/1998/namespace}id"
VOID_TAGS = ["br", "hr", "img", "lb", "pb", "milestone", "link", "meta"]
STRAY_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"
REF_ATTRIBUTES = ["who", "corresp", "resp", "source", "ana", "ref"]
CHARACTERS = r"#char-(\d+)-(\d+)$"
INLINE_SOURCE, STANDOFF_SOURCE, EXTRACTED_SOURCE = "llm_tei", "llm_tei_annotation", "llm_extraction"
RUN_ON = "run-on"  #: rend of a paragraph that no blank parts from its speaker
DECLARATION = "<?xml version='1.0' encoding='utf-8'?>"

ET.register_namespace("", TEI_NS)


# ---- trees


def cut_out(raw: str) -> str | None:
    """The <TEI ...> element in a model's answer; what follows its start if it breaks off; null if there is none."""
    start = re.search(r"<TEI\b", raw or "")
    if not start:
        return None
    end = re.search(r"</TEI\s*>", raw)
    return raw[start.start() : end.end()] if end else raw[start.start() :].rstrip()


def parse(text: str) -> ET.Element:
    """The tree of a document, after repairs: void tags closed, root name and namespace set, stray ampersands escaped."""
    text = re.sub(STRAY_AMPERSAND, "&amp;", text)
    void = "|".join(VOID_TAGS)
    text = re.sub(rf"<({void})\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)\s*/?>", r"<\1\2/>", text, flags=re.I)
    text = re.sub(rf"</({void})\s*>", "", text, flags=re.I)
    text = re.sub(r"<(/?)\s*tei(?=[\s/>])", r"<\1TEI", text)
    if not re.search(rf'xmlns\s*=\s*"{re.escape(TEI_NS)}"', text):
        text = re.sub(r"<\s*TEI\b", f'<TEI xmlns="{TEI_NS}"', text, count=1)
    return ET.fromstring(text)


def serialize(root: ET.Element) -> str:
    """The document with a declaration, indented by two blanks a level."""
    ET.indent(root, space="  ")
    return f"{DECLARATION}\n{ET.tostring(root, encoding='unicode')}"


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def tag(local: str) -> str:
    return f"{{{TEI_NS}}}{local}"


def identifier(e: ET.Element) -> str | None:
    return e.get(XML_ID) or e.get("id")


def target_of(e: ET.Element, attribute: str) -> str | None:
    return (e.get(attribute) or "").lstrip("#") or None


def squeeze(text: str) -> str:
    return " ".join(text.split())


def plain(e: ET.Element) -> str:
    return squeeze("".join(e.itertext()))


def first(root: ET.Element, local: str) -> ET.Element | None:
    return next((e for e in root.iter() if name(e) == local), None)


def cert(e: ET.Element) -> float | None:
    return float(e.get("cert")) if e.get("cert") else None


def spans(paragraph: ET.Element, text: str) -> list[dict]:
    """Inline mentions of a paragraph, placed at the first occurrence of their words, in any case."""
    out, low = [], text.lower()
    for e in paragraph.iter():
        words = plain(e) if name(e) == "seg" and e.get("corresp") else ""
        at = low.find(words.lower()) if words else -1
        if at >= 0:
            out.append({"id": identifier(e), "kind": e.get("type", "entity"), "entity_id": target_of(e, "corresp"), "provisional_entity_id": target_of(e, "ana"), "start": at, "end": at + len(words), "text": text[at : at + len(words)], "confidence": cert(e), "source": INLINE_SOURCE})
    return out


def blocks(e: ET.Element) -> Iterator[ET.Element]:
    """Page breaks, speeches and paragraphs in document order; what they hold is theirs."""
    for child in e:
        if name(child) in ("pb", "sp", "p"):
            yield child
        else:
            yield from blocks(child)


def block_text(block: ET.Element) -> tuple[str, list[dict]]:
    """A block's text, with the mentions in it by offset: a paragraph's own, or a speech's speaker and paragraphs."""
    if name(block) == "p":
        return (text := plain(block)), spans(block, text)
    text, found = next((e.text or "" for e in block if name(e) == "speaker"), "").strip(), []
    at = len(text)
    for e in block:
        if name(e) == "p" and (words := plain(e)):
            gap = " " if at and e.get("rend") != RUN_ON else ""
            at += len(gap)
            found += [s | {"start": s["start"] + at, "end": s["end"] + at} for s in spans(e, words)]
            text += gap + words
            at += len(words)
    return squeeze(text), found


def annotations(root: ET.Element, inline: dict[str, dict]) -> list[dict]:
    """Stand-off mentions whose target is a range of characters or an inline mention."""
    out = []
    for e in (x for x in root.iter() if name(x) == "annotation"):
        target = e.get("target", "")
        given, held = re.match(CHARACTERS, target), inline.get(target.lstrip("#"), {})
        if given or held:
            start, end = map(int, given.groups()) if given else (held["start"], held["end"])
            out.append({"id": identifier(e), "kind": e.get("type"), "entity_id": target_of(e, "corresp") or held.get("entity_id"), "speaker_id": target_of(e, "resp") or target_of(e, "source"), "start": start, "end": end, "text": "".join(e.itertext()), "confidence": cert(e), "source": STANDOFF_SOURCE})
    return out


def unite(*groups: list[dict]) -> list[dict]:
    """Mentions by place, one per kind, entity and range: that of the first group."""
    once: dict[tuple, dict] = {}
    for mention in (m for g in groups for m in g):
        once.setdefault((mention["kind"], mention["entity_id"], mention["start"], mention["end"]), mention)
    return sorted(once.values(), key=lambda m: (m["start"], m["end"], m["kind"] or ""))


def read(root: ET.Element) -> dict:
    """A document as text (segments joined by line ends), segments, page references, mentions and what checks ask for.

    A page reference's offset is where the text before it ends.
    """
    body = first(root, "body")
    segments, pages, inline, page, end = [], [], [], None, 0
    for block in blocks(body) if body is not None else ():
        if name(block) == "pb":
            page = block.get("n")
            pages.append({"index": len(pages), "page_ref": page, "offset": end, "facs": block.get("facs")})
            continue
        text, found = block_text(block)
        if text:
            start = end + bool(segments)
            end = start + len(text)
            number = block.get("n", "")
            segments.append({"index": len(segments), "kind": block.get("type", "speech" if name(block) == "sp" else "text"), "page_ref": page, "line": int(number) if number.isdigit() else None, "start": start, "end": end, "text": text, "speaker_id": target_of(block, "who")})
            inline += [m | {"start": m["start"] + start, "end": m["end"] + start} for m in found]
    turns = [e for e in root.iter() if name(e) == "sp"]
    ids = {i for e in root.iter() if (i := identifier(e))}
    targets = [e.get("target", "") for e in root.iter() if name(e) == "annotation"]
    return {
        "text": "\n".join(s["text"] for s in segments),
        "segments": segments,
        "page_refs": pages,
        "mentions": unite(inline, annotations(root, {m["id"]: m for m in inline if m["id"]})),
        "has_body": body is not None,
        "speech_turns": len(turns),
        "turns_with_who": sum(bool(e.get("who")) for e in turns),
        "answer_turns": sum(e.get("type") == "answer" for e in turns),
        "answer_turns_with_who": sum(e.get("type") == "answer" and bool(e.get("who")) for e in turns),
        "annotations": len(targets),
        "dangling": [t.lstrip("#") for t in targets if t and not re.match(CHARACTERS, t) and t.lstrip("#") not in ids],
    }


def units(root: ET.Element) -> list[dict]:
    """Tagging units: all speeches if there are any, else all paragraphs; blank ones are skipped, yet counted. A page break
    without a number leaves the page as it was."""
    body = first(root, "body")
    if body is None:
        return []
    kind = "sp" if first(body, "sp") is not None else "p"
    out, page, index = [], None, 0
    for e in body.iter():
        if name(e) == "pb":
            page = e.get("n") or page
        elif name(e) == kind:
            if text := plain(e):
                number = e.get("n") or f"{index:03d}"
                out.append({"unit_index": index, "unit_id": identifier(e) or f"{kind}_{number}", "kind": kind, "speaker_id": target_of(e, "who") if kind == "sp" else None, "page_ref": page, "text": text})
            index += 1
    return out


def rewrite(root: ET.Element, ids: dict[str, str]) -> ET.Element:
    """References (lists of them too) and xml:ids by the map; xml:ids of provisional elements stay."""
    for e in root.iter():
        for a in REF_ATTRIBUTES:
            if value := e.get(a):
                e.set(a, " ".join(("#" if r.startswith("#") else "") + ids.get(r.lstrip("#"), r.lstrip("#")) for r in value.split()))
        if e.get("type") != "provisional" and e.get(XML_ID) in ids:
            e.set(XML_ID, ids[e.get(XML_ID)])
    return root


def combine(documents: list[str]) -> str:
    """Documents as one: what the divisions (or bodies) and the stand-off lists of later ones hold goes to the first's end.
    One alone stays as it is, and so does a first without a body."""
    roots = [parse(d) for d in documents] if len(documents) > 1 else []
    homes = [None if (body := first(r, "body")) is None else next((e for e in body if name(e) == "div"), body) for r in roots]
    if not homes or homes[0] is None:
        return documents[0]
    for home in homes[1:]:
        homes[0].extend(list(home) if home is not None else ())
    lists = [e for r in roots for e in r if name(e) == "standOff"]
    own = next((e for e in roots[0] if name(e) == "standOff"), None)
    if lists and own is None:
        own = ET.SubElement(roots[0], tag("standOff"))
    for other in lists:
        if other is not own:
            own.extend(list(other))
    return serialize(roots[0])


def annotate(root: ET.Element, mentions: list[dict]) -> ET.Element:
    """The document with these mentions as its only stand-off list; without any list if there are none."""
    for old in [e for e in root if name(e) == "standOff"]:
        root.remove(old)
    if mentions:
        held = ET.SubElement(ET.SubElement(root, tag("standOff")), tag("listAnnotation"))
        for i, m in enumerate(mentions):
            e = ET.SubElement(held, tag("annotation"), {XML_ID: m.get("id") or f"mention_{i}", "type": str(m["kind"]), "target": f"#char-{m['start']}-{m['end']}", "corresp": str(m["entity_id"]), "resp": m.get("source") or EXTRACTED_SOURCE})
            if m.get("confidence") is not None:
                e.set("cert", str(round(float(m["confidence"]), 4)))
            e.text = m.get("text") or ""
    return root


# ---- documents in Arrow batches

HELD_ROWS, HELD_BYTES = 256, 1 << 20
MENTION = "struct<id: string, kind: string, entity_id: string, provisional_entity_id: string, speaker_id: string, start: bigint, end: bigint, text: string, confidence: double, source: string>"
TRANSCRIPT = {
    "text": "string",
    "segments": "array<struct<index: int, kind: string, page_ref: string, line: bigint, start: bigint, end: bigint, text: string, speaker_id: string>>",
    "page_refs": "array<struct<index: int, page_ref: string, offset: bigint, facs: string>>",
    "mentions": f"array<{MENTION}>",
    "has_body": "boolean",
    **dict.fromkeys(["speech_turns", "turns_with_who", "answer_turns", "answer_turns_with_who", "annotations"], "bigint"),
    "dangling": "array<string>",
}
UNITS = {"units": "array<struct<unit_index: int, unit_id: string, kind: string, speaker_id: string, page_ref: string, text: string>>"}


def _each(docs: DataFrame, key: str, inputs: list[str], out: dict[str, str], work: Callable[..., dict]) -> DataFrame:
    """key, out and error per row: work takes the inputs' values; what it can't read is null with an error. A worker holds
    results of HELD_ROWS rows or HELD_BYTES of their inputs at once, and a document more, however large batches come."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in {key: docs.schema[key].dataType.simpleString(), **out, "error": "string"}.items())
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                try:
                    rows.append(work(*(c[i].as_py() for c in batch.columns[1:])))
                except (ET.ParseError, ValueError) as e:  # a document's damage is its row's result
                    rows.append({"error": f"{type(e).__name__}: {e}"})
                size += batch.slice(i, 1).nbytes
                if len(rows) == HELD_ROWS or size >= HELD_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + 1 - len(rows), len(rows)).cast(arrow.types[0]), *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(arrow)[1:])], schema=arrow)
                    rows, size = [], 0

    return docs.select(key, *inputs).mapInArrow(run, ddl)


def transcripts(docs: DataFrame, key: str, tei: str) -> DataFrame:
    """key, TRANSCRIPT and error per document; null is no document."""
    return _each(docs, key, [tei], TRANSCRIPT, lambda text: read(parse(text or "")))


def segment_rows(docs: DataFrame, key: str, tei: str) -> DataFrame:
    """key and a segment's columns per segment of the transcripts; a document that can't be read gives one row with its error."""
    return transcripts(docs, key, tei).select(key, "error", F.explode_outer("segments").alias("s")).where("error is not null or s is not null").select(key, "s.*", "error")


def unit_rows(docs: DataFrame, key: str, tei: str) -> DataFrame:
    return _each(docs, key, [tei], UNITS, lambda text: {"units": units(parse(text or ""))}).select(key, F.inline("units"))


def rewritten(docs: DataFrame, key: str, tei: str, ids: str) -> DataFrame:
    """(key, tei, error): references by the map in the column ids."""
    return _each(docs, key, [tei, ids], {"tei": "string"}, lambda text, m: {"tei": serialize(rewrite(parse(text or ""), dict(m or {})))})


def annotated(docs: DataFrame, key: str, tei: str, mentions: str) -> DataFrame:
    """(key, tei, error): the array of mentions, in order, as the document's stand-off list."""
    return _each(docs, key, [tei, mentions], {"tei": "string"}, lambda text, m: {"tei": serialize(annotate(parse(text or ""), m or []))})


def published(docs: DataFrame, key: str, tei: str, mentions: str) -> DataFrame:
    """(key, tei, TRANSCRIPT, error): annotated documents with their transcripts, both in one pass. One that can be annotated
    and not read again keeps its tei beside the error."""

    def work(text: str | None, found: list | None) -> dict:
        made = serialize(annotate(parse(text or ""), found or []))
        try:
            return {"tei": made, **read(parse(made))}
        except (ET.ParseError, ValueError) as e:
            return {"tei": made, "error": f"{type(e).__name__}: {e}"}

    return _each(docs, key, [tei, mentions], {"tei": "string", **TRANSCRIPT}, work)


def combined(chunks: DataFrame, key: str, order: str, tei: str) -> DataFrame:
    """(key, tei, error): the chunks of each document as one. A document's chunks meet in one task, as its text does."""
    docs = chunks.where(F.col(tei).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, tei))), lambda x: x[tei]).alias("_all"))
    return _each(docs, key, ["_all"], {"tei": "string"}, lambda texts: {"tei": combine(texts)})


# ---- documents from columns


def escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def attribute(key: str, value: Column) -> Column:
    """key="value" after a blank; nothing if the value is null."""
    safe = escape(value)
    for raw, code in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        safe = F.replace(safe, F.lit(raw), F.lit(code))
    return F.coalesce(F.concat(F.lit(f' {key}="'), safe, F.lit('"')), F.lit(""))


def element(local: str, attributes: list[Column], content: Column) -> Column:
    """An element of text; one without any closes itself."""
    start = F.concat(F.lit(f"<{local}"), *attributes)
    return F.when(F.coalesce(content, F.lit("")) == "", F.concat(start, F.lit(" />"))).otherwise(F.concat(start, F.lit(">"), escape(content), F.lit(f"</{local}>")))


def speech(attributes: list[Column], speaker: Column, text: Column, depth: int, joined: Column | None = None) -> Column:
    pad = "\n" + "  " * depth
    rend = [] if joined is None else [attribute("rend", F.when(joined, F.lit(RUN_ON)))]
    return F.concat(F.lit("<sp"), *attributes, F.lit(f">{pad}  "), element("speaker", [], speaker), F.lit(f"{pad}  "), element("p", rend, text), F.lit(f"{pad}</sp>"))


def build(source: Column, url: Column, title: Column, kind: Column, fetched: Column, sha: Column, text: Column, images: Column, publisher: str = "Generated from normalized source text.") -> Column:
    """A text's lines as a TEI document: markers as page breaks with the image of the same place, questions and answers and
    named speakers as speeches, other lines as paragraphs with their number and kind. Lines read back as they were: where no
    blank follows the speaker, the paragraph says so."""
    every = F.transform(lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("i"), marker_label(x).alias("label"), classify_line(x).alias("kind")))
    marks = F.filter(every, lambda x: x["label"].isNotNull())
    facs = F.map_from_entries(F.transform(marks, lambda x, k: F.struct(x["i"], F.get(images, k))))

    def render(x: Column) -> Column:
        n, line, label, what = attribute("n", x["i"].cast("string")), x["line"], x["label"], x["kind"]
        mark = F.concat(F.lit("<pb"), attribute("n", F.coalesce(page_ref(label), label)), F.lit(' ana="page_marker"'), attribute("facs", F.try_element_at(facs, x["i"])), F.lit(" />"))
        turn = [n, attribute("type", what)]
        asked = speech(turn, F.regexp_extract(line, r"^((?:Q|A)\.?)\s*(.*)$", 1), F.trim(F.regexp_extract(line, r"^((?:Q|A)\.?)\s*(.*)$", 2)), 4, line.rlike(r"^[QA]\.?+\S"))
        named = speech(turn, F.regexp_extract(line, r"^([^:]+:)\s*(.*)$", 1), F.trim(F.regexp_extract(line, r"^([^:]+:)\s*(.*)$", 2)), 4, line.rlike(r"^[^:]+:\S"))
        other = element("p", [n, attribute("type", F.nullif(what, F.lit("text")))], line)
        return F.when(label.isNotNull(), mark).when(what.isin("question", "answer"), asked).when((what == "speaker") & line.rlike("^[^:]+:"), named).otherwise(other)

    div = F.concat(F.lit("<div"), attribute("type", kind))
    content = F.array_join(F.transform(every, render), "\n        ")
    note = F.concat(F.lit("Small TEI profile generated from normalized transcript text; source_type="), kind, F.lit("; fetched_at="), fetched, F.lit("; raw_html_sha256="), sha, F.lit("."))
    head = [
        F.concat(F.lit(f'{DECLARATION}\n<TEI xmlns="{TEI_NS}"'), attribute("xml:id", source), F.lit(">\n  <teiHeader>\n    <fileDesc>\n      <titleStmt>\n        ")),
        element("title", [], title),
        F.lit("\n      </titleStmt>\n      <publicationStmt>\n        "),
        element("p", [], F.lit(publisher)),
        F.lit("\n      </publicationStmt>\n      <sourceDesc>\n        "),
        element("p", [], F.concat(F.lit("Original URL: "), url)),
        F.lit("\n      </sourceDesc>\n    </fileDesc>\n    <encodingDesc>\n      "),
        element("p", [], note),
        F.lit("\n    </encodingDesc>\n  </teiHeader>\n  <text>\n    <body>\n      "),
    ]
    inside = F.when(F.size(every) == 0, F.concat(div, F.lit(" />"))).otherwise(F.concat(div, F.lit(">\n        "), content, F.lit("\n      </div>")))
    return F.concat(*head, inside, F.lit("\n    </body>\n  </text>\n</TEI>"))


def synthesize(rows: DataFrame, cues: DataFrame, key: str, order: str) -> DataFrame:
    """(key, tei) from transcribed rows (key, order, page, speaker, speaker_id, text): a page break where the page changes,
    with the image of cues (key, page_ref, facs); speeches for rows with a speaker; paragraphs for others. Rows without a
    page keep the page; rows without text give no element."""
    w = Window.partitionBy(key).orderBy(order)
    facs = cues.where("page_ref <> ''").groupBy(key, F.col("page_ref").alias("page")).agg(F.max("facs").alias("facs"))
    page, body, said = F.nullif(F.col("page").cast("string"), F.lit("")), F.trim(F.coalesce("text", F.lit(""))), F.coalesce("speaker", F.lit("")) != ""
    out = rows.select(key, order, page.alias("page"), body.alias("body"), F.when(said, F.col("speaker")).alias("speaker"), F.nullif("speaker_id", F.lit("")).alias("who"))
    before = F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = (F.col("speaker").isNotNull() & (F.col("body") != "")).cast("int")
    out = out.withColumns({"turns": F.when(F.col("page").isNotNull() & ~F.col("page").eqNullSafe(before), F.col("page")), "nth": F.sum(turn).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    out = out.join(facs.withColumnRenamed("page", "turns"), [key, "turns"], "left")
    broken = F.when(F.col("turns").isNotNull(), F.concat(F.lit("<pb"), attribute("n", F.col("turns")), attribute("facs", F.nullif("facs", F.lit(""))), F.lit(" />")))
    who = F.when(F.col("who").startswith("#"), F.col("who")).otherwise(F.concat(F.lit("#"), F.col("who")))
    spoken = F.when(F.col("speaker").isNotNull(), speech([attribute("n", F.col("nth").cast("string")), attribute("who", who)], F.col("speaker"), F.col("body"), 3)).otherwise(element("p", [], F.col("body")))
    xml = F.filter(F.array(broken, F.when(F.col("body") != "", spoken)), lambda x: x.isNotNull())
    docs = out.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), xml.alias("x")))), lambda r: r["x"])).alias("xml"))
    inside = F.when(F.size("xml") == 0, F.lit("<body />")).otherwise(F.concat(F.lit("<body>\n      "), F.array_join("xml", "\n      "), F.lit("\n    </body>")))
    return docs.select(key, F.concat(F.lit(f'{DECLARATION}\n<TEI xmlns="{TEI_NS}"'), attribute("xml:id", F.col(key).cast("string")), F.lit(">\n  <text>\n    "), inside, F.lit("\n  </text>\n</TEI>")).alias("tei"))
