"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlink.llm import (
    collocations, context_tree, decontaminate, divergence, jaccard, lines, packing, pieces, quality, rules, secrets, toxicity, urls,
)
from flowlink.llm.labelled import held_out


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(values: Column, separator: str = ",") -> Column:
    """Lowercase hex of the SHA-256 of joined values."""
    return F.sha2(F.concat_ws(separator, values), 256)


@query("op1_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    spans = F.concat(F.col("pieces.starts"), F.col("pieces.ends"))
    return found.select(
        "doc_id",
        F.size("pieces.ids").cast("long").alias("n_tokens"),
        digest(F.col("pieces.ids").cast("array<string>"), " ").alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded"), 256).alias("decoded_sha256"),
        F.xxhash64(spans).alias("spans_hash"),
    )


@query("op5_secrets")
def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind"] != "novel")

    def told(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def many(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", many("assign"), many("access"), many("hex"),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"), many("novel"),
    )


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op6_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _judged(toxicity.score_toxicity(docs, table(spark, folder, "labels")), toxicity.THRESHOLD)


@query("op8_quality_classifier")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _judged(quality.score_quality(docs, table(spark, folder, "labels")), quality.THRESHOLD)


@query("op9_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = rules.judge(docs, table(spark, folder, "labels")).select("doc_id", "rules.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= rules.THRESHOLD)
    )


@query("op3_context_tree")
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.score_texts(table(spark, folder, "documents"))


DECONTAMINATION_SQL = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + 12], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM win),
placed AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
), hit AS (SELECT doc_id, item_id, i, win.size FROM placed JOIN win ON placed.words = win.words AND placed.size = win.size),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op10_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 90 * (a.n + b.n - o)
), reach AS (
  SELECT doc_id, doc_id AS r FROM doc UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON link.u = reach.r
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op4_ngram_jaccard", JACCARD_SQL)
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(table(spark, folder, "documents"))


@query("op7_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op2_url_filter")
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A page's path ends in the id of the document it shows: that document's labels are the page's."""
    pages, labels = table(spark, folder, "pages").select("page_id", "url"), table(spark, folder, "labels")
    shown = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1) AS bigint)")
    shows = pages.select("page_id", urls.path_of(F.col("url")).alias("path")).select("page_id", shown.alias("doc_id")).distinct()
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    marked = shows.join(labels, "doc_id").select("page_id", bad.alias("bad"))
    return urls.filter_urls(pages, marked, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op11_bestfit_packing")
def bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024, end=2, ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), spoken AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM spoken, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size)
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
held AS (
  SELECT * FROM cand c WHERE NOT (size = 2 AND EXISTS (
    SELECT 1 FROM cand t WHERE t.size = 3 AND t.lang = c.lang AND 100 * t.a >= 50 * c.a
      AND (array_to_string(t.w[1:2], ' ') = c.phrase OR array_to_string(t.w[2:3], ' ') = c.phrase)))
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1 : size], ' ') AS q
  FROM (SELECT *, unnest(range(1, size)) AS k FROM held)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
) JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text", "lang")
    return collocations.collocations(docs, longest=3, threshold=10, inside=50, best=2000)


DIVERGENCE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), token AS (SELECT d, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM token GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
here AS (SELECT token.lang, source, term, count(*) AS c FROM token JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (
  SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(sum(h.c), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN size s ON s.lang = g.lang LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source
  GROUP BY ALL
), share AS (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
    CAST(1 + 1000000000::HUGEINT * (coalesce(h.c, 0) + 2) // (g.n + 2 * g.v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (k.c + 2) // (s.n + 2 * s.v)::HUGEINT AS BIGINT) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM share WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
) WHERE part = 'pair' OR rank <= 10
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text", "lang", "source")
    return divergence.audit(docs, least=10, best=10)
