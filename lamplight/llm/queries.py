"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm import bpe, linedup, media, minhash, mixing, neighbours, resample, shards, toxicity, warc
from lamplight.llm.common import table


def tokenizer() -> bpe.Params:
    return bpe.Params(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), neighbours.Params(cosine=0.93))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"), shards.Params(shards=8))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), 100)
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "file", "offset", "error")))
    return out.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Params(percent=85))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.drop_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.octet_length(text).cast("long").alias("clean_bytes"), F.sha2(text, 256).alias("clean_sha256"))


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["label"].cast("string"), F.format_number(e["similarity"], 4))), ",").alias("evidence"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_media_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.round_trip(table(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["size"].cast("string"))), ",")
    feature = F.concat_ws("|", "codec", F.format_string("%.3f", "duration_s"), F.col("samples").cast("string"), ranges)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_embedding_neighbours, op2_kd_shards, op3_warc_round_trip, op4_source_mix, op5_importance_resample, op6_minhash_bayes, op7_line_templates, op8_toxicity_neighbours, op9_bpe_round_trip, op10_media_boxes, pipeline]
    return {f.__name__: f for f in own}


_COMPONENTS = """
  walk(id, seen) AS (SELECT a, a FROM links UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.seen),
  placed AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id)"""

_OP1 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links(a, b) AS (SELECT x.vec_id, y.vec_id FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    AND list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.93),
  {_COMPONENTS}
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(p.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(p.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN placed p ON p.id = e.vec_id
"""

_OP3 = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  hashed AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM own),
  first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> m THEN m END AS refers_to FROM first
"""

_OP4 = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
  sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
  turned AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sources),
  weighed AS (SELECT *, turn % 3 + 1 AS weight, source_size * 3 AS cap FROM turned),
  ordered AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares, sum(source_size) OVER () AS total FROM weighed),
  levels AS (SELECT *, CAST(total - spent AS DOUBLE) / CAST(shares AS DOUBLE) AS level FROM ordered),
  plan AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0) * weight) AS target,
    CAST(CAST('0x' || substr(md5('17:' || coalesce(source, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM levels),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS k FROM sized),
  joined AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.u, r.k, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS e FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(floor((k + 1) * e + u) - floor(k * e + u) AS BIGINT) * size AS taken FROM joined
"""

_OP6 = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
  rows_ AS (SELECT doc_id, unnest(s) AS g FROM sets),
  both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM rows_ x JOIN rows_ y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links(a, b) AS (SELECT a, b FROM both_ JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
  {_COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN placed ON id = doc_id
"""

def _op7(p: linedup.Params = linedup.Params()) -> str:
    mask = r"array_to_string(list_transform(regexp_extract_all(line, '[^ \t\x0B-\r]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END), ' ')"
    number = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
    least = ", ".join(f"min((x * {a} + {b}) % {linedup.PRIME}) AS h{i}" for i, (a, b) in enumerate(linedup.factors(p)))
    bands = " UNION ALL ".join("SELECT row_, {0} AS band, {1} FROM hashed".format(k, ", ".join(f"h{k * p.hashes + i} AS m{i}" for i in range(p.hashes))) for k in range(p.bands))
    on = ", ".join(["band", *(f"m{i}" for i in range(p.hashes))])
    enough = f"docs >= {p.docs} AND sorts >= {p.docs} AND 100 * sorts >= {p.sorts} * docs"
    return rf"""
WITH RECURSIVE texts AS (SELECT DISTINCT md5(text) AS row_, text FROM documents WHERE text IS NOT NULL),
  split_ AS (SELECT row_, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM texts),
  masked AS (SELECT row_, place, {mask} AS m FROM split_),
  lines AS (SELECT row_, place, m, string_split(m, ' ') AS t FROM masked WHERE m <> ''),
  found AS (SELECT row_, place, m, t, CAST(len(t) AS VARCHAR) || ' ' || array_to_string(t[1:{p.depth}], ' ') AS leaf, array_to_string(t[1:{p.depth}], ' ') AS begins, array_to_string(t[greatest(1, len(t) - {p.depth - 1}):len(t)], ' ') AS ends FROM lines),
  numbers AS (SELECT DISTINCT row_, {number.format("begins")} AS x FROM found UNION SELECT DISTINCT row_, {number.format("ends")} FROM found),
  hashed AS (SELECT row_, {least} FROM numbers GROUP BY row_),
  bands AS ({bands}),
  heads AS (SELECT {on}, min(row_) AS head FROM bands GROUP BY {on} HAVING count(*) > 1),
  pairs AS (SELECT DISTINCT b.row_, head FROM bands b JOIN heads USING ({on}) WHERE b.row_ <> head),
  two AS (SELECT row_, head AS other FROM pairs UNION ALL SELECT head, row_ FROM pairs),
  seen AS (SELECT t.row_, t.other, length(f.m) + 1 AS size, (f.begins IN (SELECT g.begins FROM found g WHERE g.row_ = t.other) OR f.ends IN (SELECT g.ends FROM found g WHERE g.row_ = t.other)) AS same FROM two t JOIN found f ON f.row_ = t.row_),
  shared AS (SELECT row_, other, sum(size) AS size, coalesce(sum(size) FILTER (same), 0) AS n FROM seen GROUP BY ALL),
  alinks AS (SELECT least(row_, other) AS a, greatest(row_, other) AS b FROM shared WHERE 100 * n >= {p.near} * size GROUP BY ALL HAVING count(*) = 2),
  links AS (SELECT a, b FROM alinks UNION SELECT b, a FROM alinks),
  walk(id, seen) AS (SELECT a, a FROM links UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.seen),
  near AS (SELECT id AS row_, min(seen) AS sort FROM walk GROUP BY id),
  rows_ AS (SELECT DISTINCT f.row_, m, t, leaf, coalesce(sort, f.row_) AS sort FROM found f LEFT JOIN near n ON n.row_ = f.row_ WHERE len(t) >= {p.tokens}),
  stats AS (SELECT m, any_value(t) AS t, leaf, count(*) AS docs, count(DISTINCT sort) AS sorts FROM rows_ GROUP BY m, leaf),
  leaves AS (SELECT leaf, count(*) AS lines FROM stats GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {p.docs}),
  variants AS (SELECT s.leaf, s.m, s.t FROM stats s JOIN leaves USING (leaf)),
  tokens AS (SELECT leaf, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM variants),
  votes AS (SELECT v.leaf, pos, token, n FROM (SELECT leaf, pos, token, count(*) AS n FROM tokens GROUP BY ALL) v JOIN leaves USING (leaf) WHERE 100 * n >= {p.constant} * lines),
  best AS (SELECT leaf, pos, token FROM votes QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY n DESC, token) = 1),
  agreed AS (SELECT v.leaf, v.m, len(v.t) AS size, count(*) AS n FROM variants v JOIN best b ON v.leaf = b.leaf AND v.t[b.pos] = b.token GROUP BY ALL),
  alike AS (SELECT leaf, m FROM agreed WHERE 100 * n >= {p.alike} * size),
  merged AS (SELECT a.leaf, count(*) AS docs, count(DISTINCT sort) AS sorts FROM rows_ r JOIN alike a ON a.m = r.m GROUP BY a.leaf),
  gone AS (SELECT m FROM alike JOIN merged USING (leaf) WHERE {enough} UNION SELECT m FROM stats WHERE {enough} AND m NOT IN (SELECT m FROM alike)),
  flagged AS (SELECT s.row_, s.line, s.place, f.row_ IS NOT NULL AS g FROM split_ s LEFT JOIN (SELECT row_, place FROM found WHERE m IN (SELECT m FROM gone) AND len(t) >= {p.tokens}) f USING (row_, place)),
  clean AS (SELECT row_, count(*) AS n_lines, count(*) FILTER (g) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT g), '') AS text FROM flagged GROUP BY row_)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CAST(strlen(coalesce(c.text, '')) AS BIGINT) AS clean_bytes, sha256(coalesce(c.text, '')) AS clean_sha256
FROM documents d LEFT JOIN clean c ON c.row_ = md5(d.text)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_neighbours": _OP1, "op3_warc_round_trip": _OP3, "op4_source_mix": _OP4, "op6_minhash_bayes": _OP6, "op7_line_templates": _op7()}
