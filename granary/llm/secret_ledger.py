"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every file is content-addressed: its blob is the SHA-256 of its text. The ledger
lists the pairs of blob and rule version that were scanned, with their spans. A scan takes the
distinct blobs of the versions at hand, leaves out the pairs in the ledger, matches the rules
against the rest, and joins the findings, old and new, back to all paths that bear the blob.
Changing a rule means a new rule version, so only that rule is run again.

A text is hashed first. Then the ledger tells for each rule whether the pair is new; only then is the
rule's hint, a cheaper pattern that every match contains, tried on the text, and a text that no
hint finds is left behind where it is. A ledger of few blobs is broadcast for that. Of a larger one
a Bloom filter of bounded size is, and the pairs are then joined with the ledger by their hashes; a
new pair that the filter took for a known one is looked up in a second read, which takes place only if there is any.
So a ledger that holds all pairs leaves nothing to do but hashing.

A rule is a regular expression whose matches are leftmost and don't overlap; matches whose deciding
group is too short are dropped. Only texts that a hint finds are shuffled, once for each blob and
task, and only the rules not done are matched. Spans are in code points, end exclusive. Places come
from the text's pieces between matches: their lengths and those of the matches, one row each, are
summed up in order.

Blobs that very many rows bear are joined back under several salts.

Defined results: null text counts as empty; an empty text has a blob and no findings. Repeated rows
and equal texts share one blob and each get its findings. Null ids are kept. Very long texts are
matched whole. A ledger may repeat its rows, and may hold rules that aren't asked for; spans get
their kind and order from the rules at hand. Only id and text are read, so further columns can't
clash; an empty table gives empty results, and an empty ledger stands for nothing scanned.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import checkpointed
from granary.operators.filters import bloom, only


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of that group
    version: int = 1
    hint: str = ""  # a cheaper pattern that any match that counts contains; the pattern itself if empty

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of hexadecimal digits is matched whole, so asking for 24 of them equals dropping shorter runs.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, hint="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, hint="gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, hint="xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, hint=r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39, hint="AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]+@", 0, 8),
)
RULES = BASE_RULES + EXTRA_RULES

#: The blobs of a ledger are broadcast, with a hash and a number each, if there are so many at most.
_KNOWN = 1 << 17
#: Tasks over which the rows that bear one blob are spread where they meet its findings.
_SALTS = 8

_FOUND = "array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,order:int,end:int,kind:string,before:int>>"


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _bit(k: int) -> Column:
    return F.lit(1 << k).cast("long")


def _hinted(text: Column, rules: tuple[Rule, ...], asked: list[Column]) -> Column:
    """Whether any rule that is asked may find something in the text; rules that aren't asked aren't tried."""
    return reduce(Column.__or__, [ask & text.rlike(r.hint or r.pattern) for r, ask in zip(rules, asked, strict=True)])


def _pieces(rule: Rule, text: Column) -> Column:
    """Lengths of the gaps between matches, of the matches and of their deciding groups; the last gap has no match."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    deciding = F.transform(found, lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    return F.when(text.rlike(rule.hint or rule.pattern), F.arrays_zip(gaps.alias("gap"), F.transform(found, F.char_length).alias("size"), deciding.alias("deciding")))


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, spans) with the findings of each blob's rules in todo, for rows (blob, text, todo)."""
    wanted = lambda k: F.col("todo").bitwiseAND(_bit(k)) != 0
    each = [F.when(wanted(k), F.struct(F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"), _pieces(r, F.col("text")).alias("pieces"))) for k, r in enumerate(rules)]
    per = blobs.select("blob", F.explode(F.filter(F.array(*each), lambda e: e["pieces"].isNotNull())).alias("e"))
    rows = per.select("blob", "e.rule", "e.least", F.posexplode("e.pieces").alias("k", "p")).select("blob", "rule", "least", "k", "p.*")
    upto = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(W.partitionBy("blob", "rule").orderBy("k").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    span = F.when(F.col("deciding") >= F.col("least"), F.struct((F.col("end") - F.col("size")).alias("start"), "end"))
    return rows.withColumn("end", upto).groupBy("blob", "rule").agg(F.sort_array(F.collect_list(span)).alias("spans")).where(F.size("spans") > 0)


@dataclass(frozen=True)
class _Scan:
    """Rows (id, blob, salt), the open pairs (blob, todo), and (blob, rule, spans) of the ledger and of this scan."""

    rows: DataFrame
    open: DataFrame
    seen: DataFrame
    fresh: DataFrame

    def found(self) -> DataFrame:
        return self.seen.where(F.size("spans") > 0).unionByName(self.fresh)


def _scan(df: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], id_col: str | None, text_col: str) -> _Scan:
    spark, everything = df.sparkSession, (1 << len(rules)) - 1
    id_ = F.lit(None).cast("long") if id_col is None else F.col(f"`{id_col}`")
    hashed = df.select(id_.alias("id"), blob_of(F.col(f"`{text_col}`")).alias("blob"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), _bit(k))])
    filter_, done = None, None
    if ledger is None:
        seen = spark.createDataFrame([], f"blob binary, rule string, spans {_FOUND}")
        asked, rows = [F.lit(True)] * len(rules), hashed
    else:
        seen = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
        done = checkpointed(seen.groupBy("blob").agg(F.bit_or(names[F.col("rule")]).alias("done")))
        if done.count() <= _KNOWN:
            asked = [F.coalesce(F.col("done"), F.lit(0).cast("long")).bitwiseAND(_bit(k)) == 0 for k in range(len(rules))]
            rows = hashed.join(F.broadcast(done), "blob", "left")
        else:
            filter_ = bloom(seen, ["blob"], ["rule"])
            asked, rows = [~filter_.maybe(F.col("blob"), F.lit(r.name)) for r in rules], filter_.attach(hashed, F.col("blob"))
    mask = reduce(Column.bitwiseOR, [F.when(ask, _bit(k)).otherwise(_bit(k) * 0) for k, ask in enumerate(asked)])
    rows = rows.select("id", "blob", mask.alias("asked"), F.when(_hinted(F.col("text"), rules, asked), F.col("text")).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).alias("salt"))
    rows = checkpointed(rows)  # hashes, and the texts that may hold something
    blobs = rows.groupBy("blob").agg(F.min("asked").alias("asked"))
    if filter_ is None:
        blobs = blobs.withColumn("todo", F.col("asked"))
    else:
        todo = F.lit(everything).cast("long").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))
        blobs = blobs.join(done, "blob", "left").select("blob", "asked", todo.alias("todo"))
    blobs = checkpointed(blobs.where("todo <> 0"))
    texts = rows.where("text IS NOT NULL").select("blob", "text")
    late = blobs.select("blob", F.col("todo").bitwiseAND(F.bitwise_not("asked")).alias("late")).where("late <> 0")
    if filter_ is not None and not late.isEmpty():
        again = only(hashed.select("blob", "text"), ["blob"], late).join(late, "blob")
        texts = texts.unionByName(again.where(_hinted(F.col("text"), rules, [F.col("late").bitwiseAND(_bit(k)) != 0 for k in range(len(rules))])).select("blob", "text"))
    once = texts.groupBy("blob").agg(F.first("text").alias("text")).join(blobs.select("blob", "todo"), "blob")
    return _Scan(rows.select("id", "blob", "salt"), blobs.select("blob", "todo"), seen, _scanned(once, rules))


def _entries(scanned: _Scan, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's new rows: all open pairs, with what was found."""
    each = F.array(*[F.when(F.col("todo").bitwiseAND(_bit(k)) != 0, F.lit(r.name)) for k, r in enumerate(rules)])
    pairs = scanned.open.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("rule"))
    return pairs.join(scanned.fresh, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", _empty(_FOUND)).alias("spans"))


def blob_findings(df: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(blob, spans) of the blobs with findings. Spans are sorted; `before` is the furthest end of those before."""
    return _by_blob(_scan(df, ledger, rules, None, text_col).found(), rules)


def _by_blob(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])[F.col("rule")]
    rows = found.select("blob", order.alias("order"), F.explode("spans").alias("s")).select("blob", "order", "s.start", "s.end")
    before = F.max("end").over(W.partitionBy("blob").orderBy("start", "order").rowsBetween(W.unboundedPreceding, -1))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("order") + 1)
    span = F.struct("start", "order", "end", kind.alias("kind"), F.coalesce(before, F.lit(0)).alias("before"))
    return rows.select("blob", span.alias("s")).groupBy("blob").agg(F.sort_array(F.collect_list("s")).cast(_SPANS).alias("spans"))


def _every_salt(known: DataFrame) -> DataFrame:
    return known.select(F.col("blob").alias("__blob"), "spans", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("__salt"))


def scan(df: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, entries): one row for each row of df with its id, blob and sorted spans; the ledger's new rows.

    The ledger has rows (blob, rule, spans), written from earlier entries; rules are named with
    their versions. Findings of rules that aren't asked for are left out.
    """
    scanned = _scan(df, ledger, rules, id_col, text_col)
    known = _every_salt(_by_blob(scanned.found(), rules))
    joined = scanned.rows.join(known, (F.col("blob") == F.col("__blob")) & (F.col("salt") == F.col("__salt")), "left")
    return joined.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", _empty(_SPANS)).alias("spans")), _entries(scanned, rules)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path; None where there is none yet."""
    try:
        return spark.read.parquet(path).select("blob", "rule", "spans")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def scan_increments(parts: list[DataFrame], ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of the last part, after the entries of those before were written to a new ledger and read again."""
    spark, ledger = parts[0].sparkSession, None
    for k, part in enumerate(parts):
        findings, entries = scan(part, ledger, rules, id_col, text_col)
        if k < len(parts) - 1:
            entries.write.parquet(f"{ledger_path}/part={k}")
            ledger = spark.read.parquet(ledger_path).select("blob", "rule", "spans")
    return findings


def redact(df: DataFrame, text_col: str = "text", flag: str = "redacted", ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """df with every span, and what overlaps it, replaced by the mask; `flag` tells which texts have changed.

    With a ledger's path the scan leaves out the pairs that are there, and adds its own to them. Rows whose
    blob a filter of the blobs with findings rules out pass by the join.
    """
    if flag in df.columns:
        raise ValueError(f"column {flag} exists already")
    ledger = None if ledger_path is None else read_ledger(df.sparkSession, ledger_path)
    scanned = _scan(df, ledger, rules, None, text_col)
    if ledger_path is not None:
        scanned = replace(scanned, fresh=checkpointed(scanned.fresh))
        _entries(scanned, rules).write.mode("append").parquet(ledger_path)
    found = checkpointed(_by_blob(scanned.found(), rules))
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select(*columns, blob_of(F.col(f"`{text_col}`")).alias("__own"))
    held = bloom(found, ["blob"])
    attached = held.attach(hashed, F.col("__own"))
    clean = attached.where(~held.maybe(F.col("__own"))).select(*columns, F.lit(False).alias(flag))
    rows = held.detach(attached.where(held.maybe(F.col("__own"))))
    rows = rows.withColumn("__own_salt", F.pmod(F.xxhash64(*[c for c, (_, kind) in zip(columns, df.dtypes, strict=True) if "map<" not in kind and kind != "variant"]), F.lit(_SALTS)))
    joined = rows.join(_every_salt(found).withColumnRenamed("spans", "__spans"), (F.col("__own") == F.col("__blob")) & (F.col("__own_salt") == F.col("__salt")), "left")
    text = F.when(F.col("__spans").isNull(), F.col(f"`{text_col}`")).otherwise(redacted(F.col(f"`{text_col}`"), F.col("__spans"), mask))
    changed = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return clean.unionByName(joined.select(*changed, F.col("__spans").isNotNull().alias(flag)))


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span, and what overlaps it, replaced by the mask. Spans as in scan()'s findings."""
    cut = lambda begin, end: F.substr(text, begin + 1, F.greatest(end - begin, F.lit(0)))
    parts = F.transform(spans, lambda s: F.when((s["end"] > s["before"]) & (s["start"] >= s["before"]), F.concat(cut(s["before"], s["start"]), F.lit(mask))).otherwise(F.lit("")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), cut(last, F.char_length(text)))).otherwise(text)
