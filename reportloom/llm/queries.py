"""The operators over the driver tables, one registered query each."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import chunks, decontaminate, jaccard, language, lattice, mixing, neighbours, periodic, repair, secret_scan, spelling
from .packing import pack_documents
from .stage import WORD
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that a mix of weights 1, 2, 3 takes."""
    drawn = mixing.draws(_table(spark, folder, "documents"))
    return drawn.select(
        F.col("id").alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("copies_of"))).alias("row"),
    ).drop("row")


@_query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    return token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the method finds."""
    return pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op7_repair_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as their ids come back from the compressed files."""
    path = scratch_path(spark, "ids")
    docs = _table(spark, folder, "documents")
    repair.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return repair.read_summary(spark, path)


@_query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document, with a digest of those the patterns give."""
    spans = F.col("spans")
    base = secret_scan.of_kind(spans, "assign", "access", "hex")
    return secret_scan.scan(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        *(F.size(secret_scan.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"),
        secret_scan.spelled(spans).alias("spans"),
    )


def held_out(key: str, folds: int):
    """Rows whose CRC of the id as text falls into the first of so many folds; NULL without id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def _held_out(folds: int):
    """As the queries report it: a row without id is neither held out nor learned from."""
    return F.coalesce(held_out("doc_id", folds), F.lit(False)).alias("held_out")


@_query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from four folds of five."""
    docs = _table(spark, folder, "documents")
    model = language.fit(docs, ~held_out("doc_id", 5))
    return language.predict(docs, model).select(
        "doc_id", _held_out(5), "lang_pred", "score"
    )


@_query
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Class, component and links of every document by five-word shingles at 0.75."""
    return jaccard.join(_table(spark, folder, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLES["op1_ngram_jaccard"] = rf"""WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b
    ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b, i = x.n AND i = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * i >= 75 * (x.n + y.n - i)),
  e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
  r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
  c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1),
  k AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id, component_id,
  coalesce(n_links, 0) AS n_links
FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""


@_query
def op9_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probabilities of every document, learned from nine folds of ten."""
    docs = _table(spark, folder, "documents")
    scored = lattice.score(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held_out("doc_id", 10), rounds=3)
    return scored.select(
        "doc_id", _held_out(10), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op4_chunk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, its edited text, and their likeness."""
    return chunks.compare_with_next(_table(spark, folder, "documents"))


@_query
def op5_multiprobe_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors found of every vector whose id is divisible by 50."""
    return neighbours.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    found = decontaminate.scan(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op11_decontaminate"] = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{decontaminate.WORD}') AS w FROM benchmark),
  g AS (SELECT item, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
  win AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS s
    FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM g)),
  d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{decontaminate.WORD}') AS w FROM documents),
  p AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
    FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
  m AS (SELECT r, i, p.l, item FROM p JOIN win ON p.l = win.l AND p.s = win.s),
  h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS j FROM m) GROUP BY r),
  t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r"""


def letter_lost(doc_id: int | None) -> Callable[[str], str]:
    """A run as the document spells it: one in 199 lacks a letter."""
    if doc_id is None:
        return lambda run: run
    start = zlib.crc32(f"{doc_id}:".encode())

    def spelled(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        at = h % len(run)
        return run if h % 199 else run[:at] + run[at + 1 :]

    return spelled


@_query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words, their near words, forms and roots."""
    words = spelling.count_words(_table(spark, folder, "documents"), alter=letter_lost)
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


# CRC-32 by half bytes: the checksum of a list of them, low half first, with the first value in front.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(2 * strlen({0})),
    lambda i: strpos('0123456789ABCDEF', substr(hex(encode({0})), xor(i, 1) + 1, 1))::BIGINT - 1),
    lambda c, x: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
      3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, x) & 15) + 1]::BIGINT)))"""

ORACLES["op12_spelling_variants"] = rf"""WITH RECURSIVE r AS (SELECT doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
  g AS (SELECT run, doc_id || ':' || run AS k, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY run, doc_id),
  h AS (SELECT run, c, coalesce({_CRC.format("k")}, 1) AS h FROM g),
  x AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
  v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
  l AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
  s AS (SELECT DISTINCT l.word AS a, v.word AS b FROM l JOIN v ON v.word = l.s),
  p AS (SELECT a.word AS a, b.word AS b FROM l a JOIN l b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
    UNION SELECT a, b FROM s UNION SELECT b, a FROM s),
  q AS (SELECT p.a AS word, count(*) AS n_near, first(p.b ORDER BY v.n DESC, p.b) AS form, max(v.n) AS form_n
    FROM p JOIN v ON v.word = p.b GROUP BY p.a),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form,
    CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word),
  t AS (SELECT word, word AS root, form AS next FROM f
    UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL"""


def words_repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, the words of every tenth text periodic from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).select(
        "doc_id",
        "text",
        "g",
        F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"),
    )
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    period = (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("p", period).withColumn("times", F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    root = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(root, F.col("times"))))
    text = F.when(F.col("n") > 0, F.array_join(F.slice(again, F.lit(1), F.col("n")), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, the longest one, and the text without the repeats."""
    found = periodic.runs(words_repeated(_table(spark, folder, "documents")))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period")))
    )
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.order")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.order") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(spelled, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Runs of n words with period q have at least six equal windows of six words, q apart, in a row.
ORACLES["op13_periodic_runs"] = rf"""WITH c AS (SELECT row_number() OVER () AS r, doc_id, text, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
  o AS (SELECT r, doc_id, h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM c),
  z AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
  y AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM z),
  d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM y),
  t AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT r, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 12)),
  e AS (SELECT a.r, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.r = b.r AND a.s = b.s AND a.i < b.i),
  k AS (SELECT r, q, min(i) AS start, max(i) + 6 + q - min(i) AS length
    FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e) GROUP BY r, q, g),
  u AS (SELECT r, start, length, min(q) AS period FROM k WHERE length >= 12 AND length >= 2 * q GROUP BY r, start, length),
  f AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
  m AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS spelled,
    first(start ORDER BY length DESC, start, period) AS start, max(length) AS length,
    first(period ORDER BY length DESC, start, period) AS period FROM u GROUP BY r),
  v AS (SELECT q.r, string_agg(word, ' ' ORDER BY q.i) AS kept
    FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM d) q LEFT JOIN f ON f.r = q.r AND f.i = q.i WHERE f.i IS NULL GROUP BY q.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(spelled, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m ON m.r = d.r LEFT JOIN v ON v.r = d.r"""
