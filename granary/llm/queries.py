"""The queries of the training-data operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.chat_render import CONTROL, format_conversations, read_back
from granary.llm.common import table
from granary.llm.gam import fit_quality, quality_column
from granary.llm.license_index import TEMPLATES, WORD, scan_licenses
from granary.llm.mixing import MixSettings, mix_sources
from granary.llm.packing import pack_documents, public_vocabulary
from granary.llm.partenum import jaccard_components
from granary.llm.repetition import RepetitionRules, repetition_coverage
from granary.llm.secret_ledger import RULES, scan_increments
from granary.llm.simhash import near_duplicates
from granary.llm.spelling import SpellingSettings, spelling_variants, word_counts
from granary.llm.tandem import periodic_runs
from granary.llm.toxicity import fit_toxicity, toxicity_column
from granary.llm.transport_stream import read_transport_streams, write_transport_streams
from granary.plans.session import scratch


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    padding = F.greatest(F.lit(64), F.ceil(size / 64) * 64) - size
    docs = table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("n_bytes"), F.concat(text, F.unhex(F.repeat(F.lit("00"), padding.cast("int")))).alias("payload"))
    streams = write_transport_streams(docs, "payload", ["doc_id", "n_bytes"])
    streams = streams.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = read_transport_streams(streams, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    count = lambda c: F.size(c).cast("string")
    feature = F.concat(
        F.lit("programs="), count("programs"), F.lit(" streams="), count(F.flatten(F.transform("programs", lambda p: p["streams"]))), F.lit(" packets="), F.col("packets").cast("string"),
        F.lit(" units="), count("units"), F.lit(" random_access="), count(F.filter("units", lambda u: u["random_access"])),
        F.lit(" pts="), F.array_min(F.transform("units", lambda u: u["pts"])).cast("string"), F.lit("-"), F.array_max(F.transform("units", lambda u: u["pts"])).cast("string"),
        F.lit(" errors="), (F.col("bad_packets") + F.col("crc_errors") + F.col("continuity_errors")).cast("string"),
    )
    read = read.withColumn("payload", F.get("payloads", F.lit(0))["payload"])  # of the one stream of the one program
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(table(spark, sf_dir, "documents"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_vocabulary)


def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), from_files=True)


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # two increments: a first half of the documents, then all; the ledger between them says what needs no second scan
    half = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0)) == 0)
    findings = scan_increments([half, docs], scratch(spark, "ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return findings.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    read = read_back(format_conversations(rows.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def learnable(labels: DataFrame, folds: int, out: int) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % folds != out)


def _scored(docs: DataFrame, score: Column, folds: int, out: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), score.alias("score"))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels"), 4, 2))
    return _scored(docs, quality_column(model, F.col("text")), 4, 2)


def quality_weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """docs with their label, and a weight: 2 for documents labelled good, 0.5 for those labelled bad, else 1."""
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label_quality"))
    joined = docs.join(known, F.col("doc_id") == F.col("label_id"), "left")
    return joined, F.when(F.col("label_quality") == 1, 2.0).when(F.col("label_quality") == 0, 0.5).otherwise(1.0)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    weighted, weight = quality_weights(docs, table(spark, sf_dir, "labels"))
    return mix_sources(weighted, F.col("size"), weight)


def n_words(text: Column) -> Column:
    """Number of runs of characters outside {0x20, 0x09-0x0D}."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(trimmed)
    return F.when(trimmed == "", 0).otherwise(1 + F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))).cast("long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, learnable(table(spark, sf_dir, "labels"), 3, 1))
    return _scored(docs, toxicity_column(model, F.col("text")), 3, 1)


def drop_letter(doc_id: str, word: str) -> str:
    """The word without one letter, if 31 divides the hash of id and word."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), drop_letter))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def repeat_words(doc_id: str, words: list[bytes]) -> list[bytes]:
    """In texts whose id's hash 10 divides, from some word on the words repeat."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents"), repeat_words)
    # runs are in order, so of equal exponents the first by start and period stays
    longer = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


_WORD = r"[^\x20\x09-\x0D]+"


def _op2_sql() -> str:
    rules = RepetitionRules()
    lengths = [n for n, _ in rules.ngram_percent]
    grams = {n: " || ' ' || ".join(f"lead(w, {k}) OVER p" if k else "w" for k in range(n)) for n in (3, *lengths)}
    cover = {n: " OR ".join(f"coalesce(lag(d{n}, {k}) OVER p, false)" if k else f"coalesce(d{n}, false)" for k in range(n)) for n in grams}
    bad = " OR ".join([f"100 * dup_line_chars > {rules.line_percent} * word_chars", *(f"100 * cover_{n} > {p} * word_chars" for n, p in rules.ngram_percent)])
    failed = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words_percent} * n_words)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '{_WORD}')),
lines AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_line_chars FROM r WHERE k > 1 GROUP BY 1),
t AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT doc_id, w, i, {", ".join(f"{x} AS g{n}" for n, x in grams.items())} FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, w, i, {", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS d{n}" for n in grams)} FROM g),
v AS (SELECT doc_id, w, {", ".join(f"({x}) AS v{n}" for n, x in cover.items())} FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count_if(v3) AS n_repeat_words,
  {", ".join(f"coalesce(sum(length(w)) FILTER (v{n}), 0) AS cover_{n}" for n in lengths)} FROM v GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
  {", ".join(f"coalesce(cover_{n}, 0) AS cover_{n}" for n in lengths)}
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT ({bad}) AS kept,
  dup_line_chars::BIGINT AS dup_line_chars, {", ".join(f"cover_{n}::BIGINT AS cover_{n}" for n in lengths)}
FROM a"""


def _op9_sql() -> str:
    m = MixSettings()
    return rf"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
  -ln((('0x' || substr(md5('{m.seed}:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([{", ".join(f"{x}::DOUBLE" for x in m.weights)}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.weights)}] AS weight,
  ({m.max_epochs} * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER up AS place, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW up AS (ORDER BY cap / weight, source NULLS LAST)),
v AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM v) * weight, cap)), 6) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT b.source, any_value(target - epochs * source_size) AS budget, list({{'room': 0::DOUBLE, 'size': size, 'id': doc_id, 'ids': []::BIGINT[]}} ORDER BY key, doc_id, size) FILTER (size > 0) AS xs
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY 1),
p AS (SELECT source, unnest(list_reduce(xs, lambda a, x: CASE WHEN x.size <= a.room THEN {{'room': a.room - x.size, 'size': 0::BIGINT, 'id': 0::BIGINT, 'ids': list_append(a.ids, x.id)}} ELSE a END,
  {{'room': budget, 'size': 0::BIGINT, 'id': 0::BIGINT, 'ids': []::BIGINT[]}}).ids) AS pick FROM g)
SELECT doc_id, d.source, size, source_size, target, (size * (epochs + (pick IS NOT NULL)::INT))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN p ON doc_id = pick AND p.source IS NOT DISTINCT FROM d.source"""


def _op4_sql() -> str:
    each = []
    for t in TEMPLATES:
        at = lambda k: f"(CASE WHEN i + {k} >= 0 THEN ws[i + {k + 1}] END)"
        first = next(iter(t.mandatory))
        stands = " AND ".join(f"{at(k)} = '{w}'" for k, w in t.mandatory.items())
        share = f"list_sum(list_transform(range({len(t.words)}), lambda k: CASE WHEN i + k >= 0 AND ws[i + k + 1] = {t.words}[k + 1] THEN 1 ELSE 0 END))"
        each.append(f"""
SELECT doc_id, '{t.label}' AS label, {t.base} AS base, {t.share} AS least, i AS start, {share} / {len(t.words)}::DOUBLE AS share
FROM (SELECT doc_id, ws, place - {first} AS i FROM p WHERE word = '{t.mandatory[first]}') WHERE {stands}""")
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM w),
m AS ({" UNION ALL ".join(each)}),
a AS (SELECT doc_id, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM m WHERE share >= least GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN a USING (doc_id)"""


def _op5_sql(words: int = 3, percent: int = 90) -> str:
    gram = "[" + ", ".join(f"lead(w, {k}) OVER p" if k else "w" for k in range(words)) + "]"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM t),
g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, i, n, {gram} AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= n - {words - 1}
  UNION ALL SELECT doc_id, ws AS gram FROM t WHERE len(ws) BETWEEN 1 AND {words - 1}),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
  (SELECT count(*) FROM l WHERE l.a = r.doc_id) AS n_links
FROM r LEFT JOIN c USING (doc_id) GROUP BY doc_id"""


def _op6_sql() -> str:
    spans = []
    for k, r in enumerate(RULES):
        spans.append(rf"""
SELECT doc_id, '{r.kind}' AS kind, {k} AS k, m, d, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT doc_id, found, gaps, generate_subscripts(found, 1) AS i, unnest(found) AS m, unnest(deciding) AS d
  FROM (SELECT doc_id, regexp_extract_all(text, $${r.pattern}$$) AS found, string_split_regex(text, $${r.pattern}$$) AS gaps, regexp_extract_all(text, $${r.pattern}$$, {r.group}) AS deciding FROM d))
WHERE length(d) >= {r.least}""")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(spans)}),
f AS (SELECT doc_id, kind, k, start, kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT AS span FROM s),
a AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


def _op7_sql() -> str:
    body = "replace(text, '\\', '\\\\')"
    for token in CONTROL:
        body = f"replace({body}, '{token}', '{token[0]}\\{token[1:]}')"
    return rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
b AS (SELECT *, {body} AS body FROM t),
f AS (SELECT *, CASE role WHEN 'user' THEN '[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN ' ' || body || '</s>' WHEN 'system' THEN '[SYS] ' || body || ' [/SYS]'
  ELSE '[ROLE]' || {body.replace("replace(text,", "replace(role,")} || '[/ROLE] ' || body || ' [END]' END AS piece FROM b)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(piece)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


def _op11_sql() -> str:
    s = SpellingSettings()
    steps = []  # of CRC-32 over one byte, the polynomial's bits reversed
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        steps.append(byte)
    hexed = "hex(encode(doc_id::VARCHAR || ':' || run))"
    data = f"list_transform(range(length({hexed}) // 2), lambda k: ('0x' || substr({hexed}, (2 * k + 1)::INT, 2))::BIGINT)"
    return f"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT {steps}::BIGINT[] AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM r WHERE length(run) >= {s.least} GROUP BY 1, 2),
h AS (SELECT run, c, xor(list_reduce({data}, lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h FROM d, steps),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM v GROUP BY 1 HAVING length(word) >= {s.least} AND sum(c) >= {s.occurrences}),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT k.word, w.word FROM k JOIN w ON k.less = w.word UNION SELECT w.word, k.word FROM k JOIN w ON k.less = w.word),
b AS (SELECT a AS word, count(*) AS n_near, arg_min({{'form': w.word, 'n': w.n}}, {{'a': -w.n, 'b': w.word}}) AS best FROM p JOIN w ON w.word = p.b GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {s.ratio} * w.n THEN best.form END AS form, CASE WHEN best.n >= {s.ratio} * w.n THEN best.n END AS form_n FROM w LEFT JOIN b USING (word)),
z AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL),
x AS (SELECT word, arg_max(root, step) AS root FROM z GROUP BY 1)
SELECT word, n, n_near, form, form_n, root FROM f JOIN x USING (word)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_streams": op1_transport_streams,
    "op2_repetition_coverage": op2_repetition_coverage,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_license_index": op4_license_index,
    "op5_partenum_join": op5_partenum_join,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_chat_rendering": op7_chat_rendering,
    "op8_quality_gam": op8_quality_gam,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash_trie": op12_simhash_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_repetition_coverage": _op2_sql(),
    "op4_license_index": _op4_sql(),
    "op5_partenum_join": _op5_sql(),
    "op6_secret_ledger": _op6_sql(),
    "op7_chat_rendering": _op7_sql(),
    "op9_source_mixing": _op9_sql(),
    "op11_spelling_variants": _op11_sql(),
}
