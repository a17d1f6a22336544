"""The corpus operators as registered queries over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import bpe, byte_bpe, chat, collocations, embedding_dedup, language_model, mixing, secret_scan, simhash, sketches, spelling, toxicity, url_filter
from careflow.llm.common import ship_package
from careflow.sources.store import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def tokenizer_file() -> str:
    """The byte-level BPE vocabulary: the file that TOKENIZER_FILE names, else the installed one."""
    if path := os.environ.get("TOKENIZER_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; 1 for NULL."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(1))


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


URL_RULES = [
    url_filter.UrlRule.parse(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
]


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those that the rules decide, with the rule's verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


EMBEDDING_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM vectors
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (
  SELECT vec_id, vec_id AS node FROM vectors
  UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.node)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links, min(node) AS component_id, r.vec_id = min(node) AS kept
FROM reached r GROUP BY r.vec_id
"""


@query("op3_embedding_near_dedup", EMBEDDING_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sources),
total AS (SELECT 1.5::DOUBLE * sum(source_size) AS words, sum(weight) AS weights FROM weighed),
levels AS (
  SELECT row_number() OVER filling AS place, cap / weight AS ratio,
         ((SELECT words FROM total) - coalesce(sum(cap) OVER before, 0)) / ((SELECT weights FROM total) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW filling AS (ORDER BY cap / weight, source NULLS LAST),
         before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT arg_min(level, place) FILTER (WHERE level <= ratio) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap, weight * coalesce(level, 0)) AS target FROM weighed, best),
drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""


@query("op4_source_mixing", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def span_list(found: str, base_only: bool) -> Column:
    """kind:start:end of the findings, comma-joined."""
    spans = F.filter(found, lambda x: x["kind_no"] < len(secret_scan.BASE_RULES)) if base_only else F.col(found)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_sql() -> str:
    """Matches of each rule beside the pieces of text before them, whose lengths add up to places."""
    found = []
    for n, rule in enumerate(secret_scan.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        found.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {n} AS kind_no, unnest(range(len(matches))) AS n, unnest(matches) AS match, unnest(parts[1:len(parts) - 1]) AS part,"
            f" {pattern} AS pattern FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS matches, string_split_regex(text, {pattern}) AS parts FROM texts)"
        )
    long_enough = " AND ".join(
        f"(kind_no <> {n} OR length(regexp_extract(match, '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group})) >= {rule.least})"
        for n, rule in enumerate(secret_scan.RULES)
    )
    base = f"kind_no < {len(secret_scan.BASE_RULES)}"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
placed AS (SELECT *, CAST(sum(length(part) + length(match)) OVER (PARTITION BY doc_id, kind_no ORDER BY n) AS BIGINT) AS until FROM found),
spans AS (
  SELECT doc_id, kind, kind_no, until - length(match) AS start, kind || ':' || (until - length(match)) || ':' || until AS span
  FROM placed WHERE {long_enough}),
listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
         string_agg(span, ',' ORDER BY start, kind_no) FILTER ({base}) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON l.doc_id IS NOT DISTINCT FROM d.doc_id"""


@query("op6_secret_scan", secret_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ledger, so that every text is unseen; each document is the one version of its path."""
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    named = ledger.scan(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"], "text")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of = [number(r.kind) for r in secret_scan.BASE_RULES]
    return ledger.findings_by_path(named).select(
        "doc_id", *of, F.sha2(span_list("found", True).cast("binary"), 256).alias("base_sha256"), span_list("found", False).alias("spans")
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    score = toxicity.scorer(docs, toxicity.fit(docs, labels))
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_language_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = language_model.score(docs, remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_document_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    beside = sketches.with_next(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = beside.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return sketches.with_sketch(rows, "edited", "edited_sketch").select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketches.fingerprint_text(F.col("sketch")).alias("fingerprint"),
        sketches.fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


CHAT_SQL = """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
rolled AS (
  SELECT *, md5(string_agg(coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-'), '|')
                OVER (PARTITION BY conv_id ORDER BY place)) AS prefix,
         max(place) OVER (PARTITION BY conv_id) AS n_turns FROM placed),
whole AS (SELECT n_turns, prefix, min(conv_id) AS conv_id FROM rolled WHERE place = n_turns GROUP BY ALL),
kept AS (SELECT conv_id, n_turns FROM whole w WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.place < r.n_turns AND r.place = w.n_turns AND r.prefix = w.prefix))
SELECT r.conv_id, CAST((r.place - 1) // 512 AS INTEGER) AS part, CAST(k.n_turns AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), ''
                  ORDER BY r.place) AS text
FROM rolled r JOIN kept k ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""


@query("op10_chat_formatting", CHAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def rank_file() -> str:
    """The ranks of a byte-level BPE vocabulary: the file that RANK_FILE names, else the installed one."""
    if path := os.environ.get("RANK_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op11_byte_level_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rank_file()
    ids = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return byte_bpe.decode(ids, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
hashed AS (
  SELECT run, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, {crc_table()}[xor(c & 255, b) + 1]))) AS h
  FROM runs WHERE length(run) >= 6),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, count(*) AS n
  FROM hashed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
reached AS (SELECT word, word AS node FROM formed UNION ALL SELECT r.word, f.form FROM reached r JOIN formed f ON f.word = r.node WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.node AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN reached r ON r.word = f.word JOIN formed l ON l.word = r.node AND l.form IS NULL
"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in 199 loses a code point, by the hash of its document's id and itself."""
    run = F.explode(spelling.runs(F.col("text"))).alias("run")
    found = documents(spark, sf_dir).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 6)
    return spelling.group_variants(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5"))


COLLOCATION_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM worded, range(1, 6) AS sizes(k) WHERE len(words) >= k),
counted AS (SELECT lang, k, words[i:i + k - 1] AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT p.lang, p.k, p.phrase, p.f AS a, cut, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * p.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted WHERE k > 1) p
  JOIN counted l ON l.lang = p.lang AND l.phrase = p.phrase[1:cut] JOIN counted r ON r.lang = p.lang AND r.phrase = p.phrase[cut + 1:]
  JOIN totals t ON t.lang = p.lang),
inside AS (
  SELECT lang, phrase[1:k - 1] AS phrase, f FROM counted WHERE k > 1 UNION ALL SELECT lang, phrase[2:] AS phrase, f FROM counted WHERE k > 1),
covered AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
kept AS (
  SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE place = 1 AND coalesce(longer, 0) < a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", COLLOCATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir).select("lang", "text"))
