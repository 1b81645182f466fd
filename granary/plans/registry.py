"""The queries over the driver's tables, with their DuckDB SQL.

Columns are scalar, so both sides can be compared value by value: arrays are joined or hashed,
floating-point results are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import tokens as K
from granary.operators import chat, dedup, metrics, ordering, sampling
from granary.plans.session import scratch
from granary.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The white space of functions.text.SPACE, as DuckDB writes it.
_SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


# ---- cleaning and exact duplicates


@query("SELECT doc_id, lang FROM documents WHERE n_chars >= 1000")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("n_chars >= 1000").select("doc_id", "lang")


@query("SELECT count(*) AS n FROM documents")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


def _marked(text: Column) -> Column:
    return F.concat(text, F.when(F.col("doc_id") % 7 == 0, F.lit("\u202e\u200f")).otherwise(F.lit("")))


_MARKED = "text || CASE WHEN doc_id % 7 = 0 THEN chr(8238) || chr(8207) ELSE '' END"


@query(f"SELECT doc_id, md5(regexp_replace(t, '{_BIDI}', '', 'g')) AS text_md5, regexp_matches(t, '{_BIDI}') AS cleaned FROM (SELECT doc_id, {_MARKED} AS t FROM documents)")
def bidi_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", _marked(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5(X.clean_bidi(F.col("t"))).alias("text_md5"), X.was_cleaned(F.col("t")).alias("cleaned"))


@query(
    r"""SELECT event_id, '{"k":{"k":' || (props->>'$.k') || '},"x":["a b",1]}' AS value, event_id % 2 = 0 AS cleaned FROM events"""
)
def json_deep_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    mark = F.when(F.col("event_id") % 2 == 0, F.lit("\u2066")).otherwise(F.lit(""))
    line = F.concat(F.lit('{"x": ["a '), mark, F.lit('b", 1], "k": '), F.col("props"), F.lit("}"))
    return events.select("event_id", X.canonical_json_exact(line).alias("r")).select("event_id", "r.value", "r.cleaned")


@query(r"""SELECT event_id, '{"a":{"k":' || (props->>'$.k') || '},"b":' || event_id || '}' AS canonical FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('{ "b": '), F.col("event_id").cast("string"), F.lit(', "a" : '), F.col("props"), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", X.canonical_json(line).alias("canonical"))


@query(
    f"""SELECT doc_id, i::INT AS line_no, md5(regexp_replace(line, '^{_SPACE}+', '')) AS line_md5 FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text || chr(10) || chr(160) || ' ' || chr(10) || chr(8195) || 'end', chr(10)) AS ls FROM documents))
WHERE regexp_replace(line, '{_SPACE}+', '', 'g') <> ''"""
)
def blank_line_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit("\n\u00a0 \n\u2003end"))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.where(~X.is_blank(F.col("line"))).select("doc_id", (F.col("i") + 1).alias("line_no"), F.md5(X.lstrip(F.col("line"))).alias("line_md5"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    line = F.when(k == 0, F.lit(" \u00a0")).when(k == 1, F.lit('{"a":')).when(k == 2, F.lit("null")).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("file"), line.alias("line"))


@query(
    """SELECT event_type AS file, count(*) AS raw, count_if(event_id % 5 < 2) AS skipped, count_if(event_id % 5 >= 2) AS valid FROM events GROUP BY 1"""
)
def tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.line_statistics(_lines(spark, sf_dir))


@query("SELECT event_type AS file, count(*) AS n_quarantined FROM events WHERE event_id % 5 = 1 GROUP BY 1")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.invalid_json(_lines(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("n_quarantined"))


@query("""SELECT unnest(['k', event_type]) AS field, count(*) AS n_lines FROM events GROUP BY 1""")
def field_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('{"k": 1, "'), F.col("event_type"), F.lit('": [2]}'))
    return files.field_union(read(spark, sf_dir, "events").select(line.alias("line")))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS kind FROM events")
def strict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.from_json("props", "k long").alias("p")))
    typed = files.typed_json(files.strict_json(read(spark, sf_dir, "events").select(F.lit("events").alias("file"), line.alias("line"))), "event_id long, kind string, p struct<k:long>")
    return typed.select("event_id", F.col("p.k").alias("k"), "kind")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *[X.content_hash(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@query(
    f"""SELECT doc_id, lang, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(regexp_replace({_MARKED}, '{_BIDI}', '', 'g')) ORDER BY doc_id) = 1"""
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("hash", X.content_hash(X.clean_bidi(_marked(F.col("text")))))
    return dedup.exact_dedup(docs.select("doc_id", "lang", "n_chars", "hash"), F.col("hash"), [F.col("doc_id")], from_files=True).select("doc_id", "lang", "n_chars")


_REPEATED = "SELECT doc_id // 2 AS place, lang, text FROM documents UNION ALL SELECT doc_id // 2, lang, text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT NULL, lang, text FROM documents WHERE doc_id % 5 = 0"


@query(f"""SELECT text_md5, place, count(*) AS n FROM (
SELECT md5(text) AS text_md5, place FROM ({_REPEATED}) QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY place NULLS FIRST) = 1) GROUP BY 1, 2""")
def exact_dedup_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat, and order keys that several texts share or that are null."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("place"), "lang", "text")
    rows = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 5 = 0").withColumn("place", F.lit(None).cast("long"))).drop("doc_id")
    kept = dedup.exact_dedup(rows, X.content_hash(F.col("text")), [F.col("place")])
    return kept.groupBy(F.md5("text").alias("text_md5"), "place").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT count(*) AS total, count_if(trim(text) = '') AS skipped, count_if(doc_id % 7 = 0) AS cleaned, count_if(trim(text) <> '') AS valid,
count(DISTINCT md5(regexp_replace({_MARKED}, '{_BIDI}', '', 'g'))) AS unique_rows, count(*) - count(DISTINCT md5(regexp_replace({_MARKED}, '{_BIDI}', '', 'g'))) AS duplicates FROM documents"""
)
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _marked(F.col("text"))
    docs = read(spark, sf_dir, "documents").select(X.is_blank(F.col("text")).alias("blank"), X.was_cleaned(text).alias("cleaned"), F.md5(X.clean_bidi(text)).alias("hash"))
    by_hash = docs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("blank"), F.count_if("cleaned").alias("cleaned"))
    return by_hash.agg(
        F.sum("n").alias("total"), F.sum("blank").alias("skipped"), F.sum("cleaned").alias("cleaned"), (F.sum("n") - F.sum("blank")).alias("valid"),
        F.count(F.lit(1)).alias("unique_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


@query("SELECT coalesce(source, '(all)') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("(all)")).alias("source"), "n")


# ---- files: written to the shared folder and read back


def _jsonl(df: DataFrame, name: str = "lines", **how) -> str:
    path = scratch(df.sparkSession, name)
    sinks.write_jsonl(df, path, **how)
    return path


@query("SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _jsonl(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"))
    typed = files.typed_json(files.valid_json(files.read_lines(spark, path, "part-*")), "doc_id long, text string, lang string, n_chars long")
    return typed.select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@query("""SELECT doc_id, '{"doc_id": ' || doc_id || ', "lang": "' || lang || '", "n_chars": ' || n_chars || '}' AS line FROM documents""")
def jsonl_default_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _jsonl(sinks.without(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source"), "source", "absent"), spaced=True)
    lines = files.read_lines(spark, path)
    return lines.select(F.try_variant_get(F.try_parse_json("line"), "$.doc_id", "long").alias("doc_id"), "line")


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1")
def text_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _jsonl(read(spark, sf_dir, "documents").select("text", "lang"))
    return files.text_field(files.read_lines(spark, path)).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT messages_md5, count(*) AS n FROM (SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY 1) GROUP BY 1""")
def chat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _jsonl(chat.nest(read(spark, sf_dir, "conversations")).select("messages"))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return files.chat_records(files.read_lines(spark, path)).groupBy(F.md5(said).alias("messages_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text || chr(10) || 'ab', chr(10))) AS line FROM documents) GROUP BY 1""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    line = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("0A61FF620D"))).cast("string")  # a byte that is no UTF-8, a carriage return
    read(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    lines = files.read_lines(spark, path, drop_bad_bytes=True)
    return lines.groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT k // 2500 + 1 AS shard, k % 2500 + 1 AS line_no, '{"a":' || event_id AS line, 'Expecting '','' delimiter: line 1 column ' || (6 + length(event_id::VARCHAR)) || ' (char ' || (5 + length(event_id::VARCHAR)) || ')' AS error
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) WHERE event_id % 5 = 1"""
)
def quarantine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers and errors of the lines that are no JSON, in files of 2,500 lines."""
    events = ordering.positions(read(spark, sf_dir, "events").select("event_id", "props"), [F.col("event_id")])
    line = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"a":'), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    path = scratch(spark, "shards")
    rows = events.select((F.floor(F.col("position") / 2500) + 1).alias("shard"), "position", line.alias("value"))
    rows.repartition("shard").sortWithinPartitions("shard", "position").select("shard", "value").write.partitionBy("shard").text(path)
    lines = spark.read.text(path).select("shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return files.quarantined(files.numbered(lines)).select(F.col("shard").cast("long"), F.col("line_no").cast("long"), "line", "error")


@query("SELECT (k // 300 + 1)::BIGINT AS shard, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) GROUP BY 1")
def sharded_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sharded")
    sinks.write_sharded_jsonl(_docs(spark, sf_dir), path, [F.col("doc_id")], 300)
    rows = spark.read.text(path).select(F.col("shard").cast("long").alias("shard"), F.from_json("value", "doc_id long")["doc_id"].alias("doc_id"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


@query("SELECT DISTINCT n_chars AS id FROM documents")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    sinks.write_ids(read(spark, sf_dir, "documents").select(F.col("n_chars").alias("id")), path, "id")
    return files.read_ids(spark, path, "id")


@query("SELECT doc_id, source, NULL::BIGINT AS n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, n_chars FROM documents WHERE doc_id % 2 = 1")
def parquet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of different columns, read with the union of them."""
    path, docs = scratch(spark, "parquet"), read(spark, sf_dir, "documents")
    sinks.write_parquet(docs.where("doc_id % 2 = 0").select("doc_id", "source"), f"{path}/half=0")
    sinks.write_parquet(docs.where("doc_id % 2 = 1").select("doc_id", "n_chars"), f"{path}/half=1")
    return files.read_parquet(spark, path, ["doc_id", "source", "n_chars"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 1")
def overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write replaces the first one."""
    path, docs = scratch(spark, "twice"), read(spark, sf_dir, "documents").select("doc_id", "lang")
    for k in range(2):
        sinks.write_jsonl(docs.where(F.col("doc_id") % 2 == k), path)
    return files.typed_json(files.valid_json(files.read_lines(spark, path)), "doc_id long, lang string").select("doc_id", "lang")


# ---- order, shuffles, splits


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source")


_SHUFFLED = "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents"


@query("SELECT row_number() OVER (ORDER BY source, doc_id) + 99 AS row_id, doc_id FROM documents")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.row_ids(_docs(spark, sf_dir), [F.col("source"), F.col("doc_id")], "row_id", 100).select("row_id", "doc_id")


@query(f"SELECT doc_id, position FROM ({_SHUFFLED})")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffled(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", "position")


@query(
    """SELECT doc_id, c * 100 + row_number() OVER (PARTITION BY c ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position
FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS c FROM documents)"""
)
def buffered_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.buffered_shuffle(_docs(spark, sf_dir), [F.col("doc_id")], ["doc_id"], 100).select("doc_id", "position")


@query(f"SELECT doc_id, CASE WHEN n <= 100 OR position >= n - 100 THEN 'valid' ELSE 'train' END AS split FROM ({_SHUFFLED})")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return ordering.holdout(ordering.shuffled(docs, ["doc_id"]), 100, docs.count()).select("doc_id", "split")


@query(
    f"""SELECT doc_id, CASE WHEN position < trunc(n * 0.6::DOUBLE) THEN 'main' WHEN position < trunc(n * 0.6::DOUBLE) + trunc(n * 0.25::DOUBLE) THEN 'aux' ELSE 'debug' END AS split
FROM ({_SHUFFLED})"""
)
def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return ordering.ratio_split(ordering.shuffled(docs, ["doc_id"]), docs.count()).select("doc_id", "split")


@query(
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents),
q AS (SELECT *, trunc(n * 0.6::DOUBLE) - 100 AS a, trunc(n * 0.25::DOUBLE) AS b, trunc(n * 0.15::DOUBLE) AS c FROM p)
SELECT doc_id, CASE WHEN position < a THEN 'train' WHEN position < a + b THEN 'second' WHEN position < a + b + c THEN 'third' ELSE 'extra' END AS split
FROM q WHERE position < a + b + c + least(100, n - a - b - c)"""
)
def sequential_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return ordering.sequential_split(ordering.positions(docs, [F.col("doc_id")]), docs.count(), 100).select("doc_id", "split")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 + 1 AS shard FROM documents")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.shards(_docs(spark, sf_dir), [F.col("doc_id")], 300).select("doc_id", "shard")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS age FROM events QUALIFY age <= 3")
def retain_latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.latest(read(spark, sf_dir, "events"), 3, F.col("ts"), F.col("event_id"), "user_id").select("event_id", "user_id", "age")


@query(
    """SELECT doc_id, batch, batch // 4 AS "group" FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) WHERE batch >= 2"""
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.batches(ordering.positions(_docs(spark, sf_dir), [F.col("doc_id")]), 16, 2, 4).select("doc_id", "batch", "group")


# ---- near duplicates

_A, _B = dedup.permutations()
_NEAR = f"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> ''))) AS w FROM documents),
h AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dedup.MODULUS} AS h FROM t),
k AS (SELECT doc_id, md5(string_agg(h::VARCHAR, ',' ORDER BY h)) AS k FROM h GROUP BY 1),
firsts AS MATERIALIZED (SELECT min(doc_id) AS doc_id FROM k GROUP BY k),
perms AS (SELECT unnest({_A}::BIGINT[]) AS a, unnest({_B}::BIGINT[]) AS b, unnest(range({dedup.PERMUTATIONS})) AS i),
sig AS MATERIALIZED (SELECT doc_id, i, min((a * h + b) % {dedup.MODULUS}) AS m FROM h, perms GROUP BY 1, 2),
bands AS MATERIALIZED (SELECT doc_id, (i // {dedup.PERMUTATIONS // dedup.BANDS})::INT AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS key FROM sig GROUP BY 1, 2),
e AS MATERIALIZED (SELECT DISTINCT x.doc_id AS low, y.doc_id AS high FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id
  WHERE x.doc_id IN (SELECT doc_id FROM firsts) AND y.doc_id IN (SELECT doc_id FROM firsts))"""


def _kept_sql(rounds: int = 6) -> str:
    out = [_NEAR, "s0 AS (SELECT doc_id, 'U' AS s FROM firsts)"]
    for k in range(rounds):
        out.append(
            f"""s{k + 1} AS MATERIALIZED (SELECT n.doc_id, CASE WHEN any_value(n.s) <> 'U' THEN any_value(n.s) WHEN max(l.s = 'K') THEN 'D' WHEN coalesce(min(l.s = 'D'), true) THEN 'K' ELSE 'U' END AS s
FROM s{k} n LEFT JOIN e ON e.high = n.doc_id LEFT JOIN s{k} l ON l.doc_id = e.low GROUP BY 1)"""
        )
    return ",\n".join(out) + f",\nkept AS (SELECT doc_id FROM s{rounds} WHERE s = 'K')\n"


@query(
    f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> ''))) AS ws FROM documents)
SELECT doc_id, len(ws)::INT AS n_words, md5(array_to_string(ws, ' ')) AS words_md5 FROM t"""
)
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.word_sets(read(spark, sf_dir, "documents")).select("doc_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"))


@query(_NEAR + " SELECT doc_id, sum(m)::BIGINT AS signature_sum, max(m) AS signature_max FROM sig GROUP BY 1")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = dedup.signature_store(read(spark, sf_dir, "documents"))
    return signed.select("doc_id", F.aggregate("signature", F.lit(0).cast("long"), lambda a, x: a + x).alias("signature_sum"), F.array_max("signature").alias("signature_max"))


@query(_NEAR + " SELECT doc_id, band, key FROM bands")
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.bands(dedup.signatures(dedup.word_hashes(read(spark, sf_dir, "documents"))))


@query(_NEAR + " SELECT low, high FROM e")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = dedup.signature_store(read(spark, sf_dir, "documents"))
    firsts = store.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    return dedup.near_pairs(dedup.bands(firsts))


@query(_kept_sql() + "SELECT doc_id FROM kept")
def near_dup_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates from a store of signatures that was written in two parts."""
    docs, path = read(spark, sf_dir, "documents"), scratch(spark, "signatures")
    for k in range(2):
        sinks.write_parquet(dedup.signature_store(docs.where(F.col("doc_id") % 2 == k)), f"{path}/half={k}")
    return dedup.near_dedup_stored(files.read_parquet(spark, path, ["doc_id", "digest", "signature"]))


_NULLED = "FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN text END AS text FROM documents)"


@query(_kept_sql().replace("FROM documents", _NULLED) + "SELECT doc_id FROM kept UNION ALL SELECT min(doc_id) FROM documents WHERE doc_id % 5 = 0")
def near_dup_null_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the texts are null: they count as blank, and as equal."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"))
    return dedup.near_dedup(docs)


@query(_kept_sql() + "SELECT doc_id FROM kept")
def near_dup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_dedup(read(spark, sf_dir, "documents"))


@query(_kept_sql() + "SELECT count_if(doc_id IN (SELECT doc_id FROM kept)) AS kept, count_if(doc_id NOT IN (SELECT doc_id FROM kept)) AS duplicates FROM documents")
def near_dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = dedup.near_dedup(docs).agg(F.count(F.lit(1)).alias("kept"))
    return kept.crossJoin(docs.agg(F.count(F.lit(1)).alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("duplicates"))  # one row each


@query(_kept_sql() + "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM kept)")
def semi_join_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return dedup.semi_join(docs.select("doc_id", "lang", "n_chars"), dedup.near_dedup(docs))


@query(
    _kept_sql()
    + """SELECT t, count(*) AS n FROM (SELECT md5(text) AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM kept)) GROUP BY 1"""
)
def near_dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that near-duplicate resolution keeps, where a third of them have no id."""
    docs = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id"), "text")
    return dedup.near_dedup_rows(docs, from_files=True).groupBy(F.md5("text").alias("t")).agg(F.count(F.lit(1)).alias("n"))


# ---- chat


@query(
    """SELECT conv_id, count(*)::INT AS n_messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY 1"""
)
def nested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = chat.nest(read(spark, sf_dir, "conversations"))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return nested.select("conv_id", F.size("messages").alias("n_messages"), F.md5(joined).alias("messages_md5"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, role, md5(text) AS content_md5 FROM conversations")
def messages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.flat(chat.nest(read(spark, sf_dir, "conversations"))).select("conv_id", "position", "role", F.md5("content").alias("content_md5"))


@query(
    f"""SELECT conv_id, md5(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS human_md5,
md5(CASE WHEN next_role = 'assistant' THEN regexp_replace(next_text, '^{_SPACE}+|{_SPACE}+$', '', 'g') ELSE '' END) AS assistant_md5
FROM (SELECT *, lead(role) OVER p AS next_role, lead(text) OVER p AS next_text FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"""
)
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = chat.nest(read(spark, sf_dir, "conversations"))
    pairs = nested.select("conv_id", F.explode(chat.paired(F.col("messages"))).alias("p"))
    return pairs.select("conv_id", F.md5("p.human").alias("human_md5"), F.md5("p.assistant").alias("assistant_md5"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.col("lang").alias("prompt"), F.col("source").alias("response"))
    turns = F.array(F.struct(F.col("lang").alias("human"), F.col("source").alias("assistant")), F.struct(F.col("source").alias("human"), F.lit(None).cast("string").alias("assistant")))
    k = F.col("doc_id") % 4
    line = F.when(k == 0, F.to_json(pair)).when(k == 1, F.to_json(F.struct(turns.alias("conversation")))).when(k == 2, F.to_json(F.struct("lang"))).otherwise(F.lit("[1, {"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), line.alias("line"))


@query(
    """SELECT doc_id::VARCHAR AS file, CASE doc_id % 4 WHEN 0 THEN 'user:' || lang || '|assistant:' || source ELSE 'user:' || lang || '|assistant:' || source || '|user:' || source END AS messages
FROM documents WHERE doc_id % 4 < 2"""
)
def records_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.records_to_messages(_records(spark, sf_dir))
    return made.select("file", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


@query(
    """SELECT doc_id::VARCHAR AS file, lang AS human, source AS assistant FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id::VARCHAR, source, '' FROM documents WHERE doc_id % 4 = 1"""
)
def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns_to_rows(_records(spark, sf_dir))


@query("SELECT conv_id, count(*) AS n_turns, count_if(role = 'user') AS n_user, count_if(role = 'assistant') AS n_assistant FROM conversations GROUP BY 1")
def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"))


# ---- training arrays


def _ids_sql(text: str) -> str:
    ws = f"list_filter(string_split_regex({text}, '{_SPACE}+'), lambda x: x <> '')"
    return f"list_transform({ws}, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % {K.VOCABULARY - K.FIRST_WORD} + {K.FIRST_WORD})::INT)"


@query(f"WITH t AS (SELECT doc_id, {_ids_sql('text')} AS ids FROM documents) SELECT doc_id, len(ids)::INT AS n_ids, len(list_distinct(ids))::INT AS n_unique FROM t")
def unique_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", K.hashed_words(F.col("text")).alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), F.size(F.array_distinct("ids")).alias("n_unique"))


@query(
    f"""WITH t AS (SELECT doc_id, list_concat([{K.BOS}], {_ids_sql("text")}, [{K.EOS}])[1:256] AS ids FROM documents)
SELECT doc_id, len(ids)::INT AS n_ids, md5(array_to_string(list_concat(ids, [{K.PAD} for i in range(256 - len(ids))]), ',')) AS ids_md5 FROM t"""
)
def encode_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", K.head(K.wrap(K.hashed_words(F.col("text"))), 256).alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), F.md5(_joined(K.pad_to(F.col("ids"), 256))).alias("ids_md5"))


@query(
    f"""WITH t AS (SELECT doc_id, list_concat([{K.BOS}], {_ids_sql("text")}, [{K.EOS}]) AS ids FROM documents),
s AS (SELECT *, CASE WHEN len(ids) > 64 THEN ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % (len(ids) - 64) ELSE 0 END AS start FROM t),
p AS (SELECT *, CASE WHEN len(ids) > 64 THEN ids[start + 1:start + 64] ELSE ids[1:len(ids) - 1] END AS x, CASE WHEN len(ids) > 64 THEN ids[start + 2:start + 65] ELSE ids[2:] END AS y FROM s)
SELECT doc_id, start::INT AS start, md5(array_to_string(list_concat(x, [{K.PAD} for i in range(64 - len(x))]), ',')) AS input_md5,
md5(array_to_string(list_concat(y, [{K.PAD} for i in range(64 - len(y))]), ',')) AS target_md5 FROM p"""
)
def shifted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", K.wrap(K.hashed_words(F.col("text"))).alias("ids"))
    docs = docs.withColumn("start", K.crop_start(F.col("ids"), 64, 7, F.col("doc_id")))
    x, y = K.training_pair(F.col("ids"), 64, F.col("start"))
    return docs.select("doc_id", "start", F.md5(_joined(x)).alias("input_md5"), F.md5(_joined(y)).alias("target_md5"))


_CHAT = f"""WITH m AS (SELECT conv_id, turn, role, list_concat([CASE role WHEN 'user' THEN {K.USER} ELSE {K.BOT} END], {_ids_sql("text")}, [{K.EOS}]) AS ids FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT conv_id, list_concat([{K.BOS}], flatten(list(ids ORDER BY turn))) AS ids, list_concat([0], flatten(list([(role = 'assistant')::INT for i in ids] ORDER BY turn))) AS mask FROM m GROUP BY 1),
p AS (SELECT conv_id, ids, CASE WHEN len(ids) > 128 THEN ids[1:128] ELSE ids[1:len(ids) - 1] END AS x, CASE WHEN len(ids) > 128 THEN ids[2:129] ELSE ids[2:] END AS y,
  CASE WHEN len(ids) > 128 THEN mask[2:129] ELSE mask[2:] END AS k FROM c)
"""


def _padded_sql(array: str, value: int) -> str:
    return f"md5(array_to_string(list_concat({array}, [{value} for i in range(128 - len({array}))]), ','))"


def _chat_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = chat.nest(read(spark, sf_dir, "conversations"))
    ids, mask = K.chat_ids(F.col("messages"), K.each(K.hashed_words))
    rows = nested.select("conv_id", ids.alias("ids"), mask.alias("mask")).where(F.size("ids") > 1)
    x, y, k = K.chat_example(F.col("ids"), F.col("mask"), 128)
    return rows.select("conv_id", F.size("ids").alias("n_ids"), x.alias("x"), y.alias("y"), k.alias("k"))


@query(_CHAT + f"SELECT conv_id, len(ids)::INT AS n_ids, coalesce(list_sum(k), 0)::INT AS n_loss, {_padded_sql('k', 0)} AS mask_md5 FROM p")
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chat_arrays(spark, sf_dir)
    return rows.select("conv_id", "n_ids", F.aggregate("k", F.lit(0), lambda a, b: a + b).alias("n_loss"), F.md5(_joined(F.col("k"))).alias("mask_md5"))


@query(_CHAT + f"SELECT conv_id, {_padded_sql('x', K.PAD)} AS input_md5, {_padded_sql('y', K.PAD)} AS target_md5, {_padded_sql('k', 0)} AS mask_md5 FROM p")
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat_arrays(spark, sf_dir).select("conv_id", F.md5(_joined(F.col("x"))).alias("input_md5"), F.md5(_joined(F.col("y"))).alias("target_md5"), F.md5(_joined(F.col("k"))).alias("mask_md5"))


@query(
    f"""WITH t AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch, list_concat([{K.BOS}], {_ids_sql("text")}, [{K.EOS}])[1:256] AS ids FROM documents)
SELECT batch, count(*)::INT AS n_rows, md5(string_agg(array_to_string(list_concat(ids, [{K.PAD} for i in range(256 - len(ids))]), ','), ';' ORDER BY doc_id)) AS ids_md5 FROM t GROUP BY 1"""
)
def stacked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", K.pad_to(K.head(K.wrap(K.hashed_words(F.col("text"))), 256), 256).alias("ids"))
    stacked = ordering.stacked(ordering.batches(ordering.positions(docs, [F.col("doc_id")]), 16), ["ids"])
    return stacked.select("batch", F.size("ids").alias("n_rows"), F.md5(F.array_join(F.transform("ids", _joined), ";")).alias("ids_md5"))


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def sentencepiece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", K.sentencepiece_ids(F.col("text"), _piece_model).alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


@query()
def chat_examples_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples by a SentencePiece model; the role tags are two of its pieces."""
    tokens = K.sentencepiece_chat_tokens(_piece_model, "<0x01>", "<0x02>")
    ids, mask = K.chat_ids(F.col("messages"), lambda texts: K.sentencepiece_ids_of_each(texts, _piece_model), tokens)
    nested = chat.nest(read(spark, sf_dir, "conversations")).where(F.size(K.said(F.col("messages"))) > 0)  # a filter of the ids would encode twice
    rows = nested.select("conv_id", ids.alias("ids"), mask.alias("mask"))
    x, y, k = K.chat_example(F.col("ids"), F.col("mask"), 256, tokens.pad)
    rows = rows.select("conv_id", F.size("ids").alias("n_ids"), x.alias("x"), y.alias("y"), k.alias("k"))
    loss = F.aggregate("k", F.lit(0), lambda a, b: a + b).alias("n_loss")
    return rows.select("conv_id", "n_ids", loss, F.md5(_joined(F.col("x"))).alias("input_md5"), F.md5(_joined(F.col("y"))).alias("target_md5"), F.md5(_joined(F.col("k"))).alias("mask_md5"))


# ---- metrics


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("value") / 100).alias("loss"))


@query(
    """SELECT event_id // 64 AS "interval", round(sum(value / 100) / 64 * 2, 6) AS mean_loss, round(exp(sum(value / 100) / 64 * 2), 6) AS perplexity FROM events GROUP BY 1 HAVING count(*) = 64"""
)
def interval_mean_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interval_means(_steps(spark, sf_dir), "event_id", "loss", 64, 2).select("interval", F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity"))


@query("""SELECT event_id // 8 AS "group", round(sum(value / 100), 6) AS total_loss FROM events GROUP BY 1 HAVING count(*) = 8""")
def accumulated_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accumulated(_steps(spark, sf_dir), "event_id", "loss", 8).select("group", F.round("total_loss", 6).alias("total_loss"))


@query("SELECT event_type, round(sum(value / 100 * (event_id % 3 = 0)::INT) / (sum((event_id % 3 = 0)::INT) + 1e-8::DOUBLE), 6) AS masked_loss FROM events GROUP BY 1")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).groupBy("event_type").agg(F.round(metrics.masked_mean(F.col("loss"), (F.col("event_id") % 3 == 0).cast("int")), 6).alias("masked_loss"))


@query("SELECT event_type, round(avg(value / 100), 6) AS mean_loss, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1")
def evaluation_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluation(_steps(spark, sf_dir), "loss", "event_type").select("event_type", F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity"))


@query(
    """SELECT event_id, best_before, best_before IS NULL OR loss < best_before AS improved FROM (
SELECT event_id, value / 100 AS loss, min(value / 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events)"""
)
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_best(_steps(spark, sf_dir), ["event_id"], "loss", ["user_id"]).select("event_id", "best_before", "improved")


@query(
    """SELECT event_id, round(CASE WHEN event_id <= turn THEN 0.001 + (0.00004 - 0.001) / 2 * (1 + cos(pi() * event_id / turn))
ELSE 0.000000004::DOUBLE + (0.001 - 0.000000004::DOUBLE) / 2 * (1 + cos(pi() * (event_id - turn) / (total - 1 - turn))) END, 9)::DOUBLE AS rate
FROM events, (SELECT max(event_id) + 1 AS total, 0.3::DOUBLE * (max(event_id) + 1) - 1 AS turn FROM events)"""
)
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule over all events: its total is the largest step plus one."""
    events = read(spark, sf_dir, "events").select("event_id")
    rows = events.crossJoin(F.broadcast(events.agg((F.max("event_id") + 1).alias("total"))))  # one row
    return rows.select("event_id", F.round(metrics.one_cycle(F.col("event_id"), F.col("total"), 0.001), 9).alias("rate"))


# ---- sampling


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit = F.round(F.col("v").cast("double") * 20) / 2  # halves, so that there are ties
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("token", "v"))
    return rows.select("seq", "token", F.when(logit == 0, 0.0).otherwise(logit).alias("logit"))


_LOGITS = """(SELECT seq, token, CASE WHEN logit = 0 THEN 0::DOUBLE ELSE logit END AS logit FROM
(SELECT vec_id AS seq, (generate_subscripts(embedding, 1) - 1)::INT AS token, round(unnest(embedding)::DOUBLE * 20) / 2 AS logit FROM embeddings))"""
_SOFT = f"(SELECT seq, token, logit, e / sum(e) OVER (PARTITION BY seq) AS p FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq)) AS e FROM {_LOGITS}))"


@query(f"SELECT seq, token, round(p, 9) AS probability FROM {_SOFT}")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.softmax(_logits(spark, sf_dir)).select("seq", "token", F.round("probability", 9).alias("probability"))


@query(f"SELECT seq, token, logit FROM (SELECT *, rank() OVER (PARTITION BY seq ORDER BY logit DESC) AS r FROM {_LOGITS}) WHERE r <= 5")
def top_k_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_k(_logits(spark, sf_dir), 5)


@query(f"SELECT seq, token, logit FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY seq ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_SOFT}) WHERE b <= 0.8")
def top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_p(_logits(spark, sf_dir), 0.8)


@query(f"SELECT seq, token, round(CASE WHEN token % 4 = seq % 4 THEN CASE WHEN logit > 0 THEN logit / 1.3::DOUBLE ELSE logit * 1.3::DOUBLE END ELSE logit END / 0.7::DOUBLE, 9) AS logit FROM {_LOGITS}")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _logits(spark, sf_dir)
    seen = logits.where("token % 4 = seq % 4").select("seq", "token")
    return sampling.with_temperature(sampling.penalised(logits, seen, 1.3), 0.7).select("seq", "token", F.round("logit", 9).alias("logit"))


@query(
    f"""SELECT seq, arg_min(token, -ln((('0x' || substr(md5('5:' || seq || ':' || token), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / p) AS token FROM {_SOFT} GROUP BY 1"""
)
def multinomial_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(_logits(spark, sf_dir), 5)


from granary.plans import relational, streams  # noqa: E402, F401 - they register their queries
