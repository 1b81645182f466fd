"""Text and JSON functions, as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bidirectional control characters, and the characters that Python's str.strip removes.
BIDI = r"[\u202A-\u202E\u2066-\u2069\u200E\u200F]"
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def clean_bidi(text: Column) -> Column:
    return F.regexp_replace(text, BIDI, "")


def was_cleaned(text: Column) -> Column:
    return F.coalesce(clean_bidi(text) != text, F.lit(False))


def clean_value(value: Column, kind: T.DataType) -> Column:
    """Cleans every string value of a nested column; struct field names and map keys stay."""
    if isinstance(kind, T.StringType):
        return clean_bidi(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: clean_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: clean_value(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNull(), F.lit(None).cast(kind)).otherwise(F.struct(*[clean_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def words(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def is_json(line: Column) -> Column:
    """Whether the line is a JSON value; the literal null is one."""
    return F.try_parse_json(line).isNotNull()


def canonical_json(line: Column) -> Column:
    """Compact JSON with sorted keys; null if the line isn't JSON.

    Stays in the JVM. 1.0 is written as 1, NaN is no JSON, and text after a complete value is passed over;
    canonical_json_exact has none of these exceptions.
    """
    return F.to_json(F.try_parse_json(line))


def _clean(value, clean):
    """The value without control characters in its strings, and whether any was there; keys stay."""
    if isinstance(value, str):
        out = clean.sub("", value)
        return out, out != value
    if isinstance(value, dict):
        parts = {k: _clean(v, clean) for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, any(c for _, c in parts.values())
    if isinstance(value, list):
        items = [_clean(v, clean) for v in value]
        return [v for v, _ in items], any(c for _, c in items)
    return value, False


def canonical_json_exact(line: Column, clean: bool = True, sort_keys: bool = True) -> Column:
    """Struct (value, cleaned) of any JSON line by a full parser, in Arrow batches; null if it isn't JSON."""
    bidi = re.compile(BIDI)

    @F.pandas_udf("value string, cleaned boolean")
    def run(lines: pd.Series) -> pd.DataFrame:
        out = []
        for x in lines:
            try:
                value, changed = _clean(json.loads(x), bidi) if clean else (json.loads(x), False)
                out.append((json.dumps(value, sort_keys=sort_keys, ensure_ascii=False, separators=(",", ":")), changed))
            except (TypeError, ValueError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["value", "cleaned"])

    return run(line)


def json_error(line: Column) -> Column:
    """What a full JSON parser says against the line, with the place; null if it is JSON."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        def error(x: str | None) -> str | None:
            try:
                json.loads(x or "")
            except ValueError as e:
                return str(e)
            return None

        return lines.map(error)

    return run(line)


def spaced_json(line: Column) -> Column:
    """A JSON line with a space after each comma and colon, in Arrow batches."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False))

    return run(line)


def content_hash(text: Column, algorithm: str = "md5") -> Column:
    """Hexadecimal digest: md5, sha1, sha224, sha256, sha384 and sha512 natively, other hashlib names in Arrow batches."""
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "sha1":
        return F.sha1(text)
    if re.fullmatch(r"sha(224|256|384|512)", algorithm):
        return F.sha2(text, int(algorithm[3:]))
    import hashlib

    hashlib.new(algorithm)  # an unknown name fails here and not in a task

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.new(algorithm, t.encode()).hexdigest())

    return run(text)


def shuffle_key(seed: int | str, *ids: Column) -> Column:
    """A reproducible pseudo-random key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def uniform(seed: int | str, *ids: Column) -> Column:
    """A reproducible number in (0, 1)."""
    return (F.conv(F.substring(shuffle_key(seed, *ids), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
