"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are word sequences with mandatory key phrases; the phrases' words are the licence words. One
pass over the texts writes, for each file, its number of words and the licence words it holds; and,
if it holds all the licence words of some template, its index: the places of all words that stand in
templates. Nothing else is kept, and the texts aren't read again.

The licence words' document frequencies are counted over all files. Each file's licence words are
then ranked by IDF. For each template of which the file has all licence words, the two that rank
highest in the file are looked up: their postings, less their places in the template, are
intersected, which leaves the starts at which both stand in the right distance. The starts of the
other licence words are intersected with those, which verifies the key phrases. An alignment stands
if at least `share` of all the template's words do; these are counted over the starts that are left.
All steps are linear in a file's postings.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII.

Defined results: null text counts as empty; a text without words has no alignment, null places, no
labels and score 0. Ties in IDF go to the word that is first by code point. Equal texts get equal
results; rows are handled one by one, repeated rows too, without any shuffle but the count of
frequencies. Null ids are kept. An alignment may begin before the text or end after it, as long as
the key phrases stand inside. Very long texts are taken whole. Only id and text are read, so further columns can't clash; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # lower-case words with single spaces
    keys: tuple[str, ...]  # mandatory phrases in it; the first occurrence counts
    base: bool = False
    share: float = 0.6

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    @property
    def mandatory(self) -> dict[int, str]:
        """The key phrases' words by place in the template."""
        out = {}
        for key in self.keys:
            want = key.split(" ")
            at = next(k for k in range(len(self.words)) if self.words[k : k + len(want)] == want)
            out |= {at + k: w for k, w in enumerate(want)}
        return dict(sorted(out.items()))


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), base=True)


# The base phrases, and notices by which licences are named or granted.
TEMPLATES = (
    _phrase("gpl", "gnu general public license"),
    _phrase("apache", "apache license"),
    _phrase("cc-by", "cc by"),
    _phrase("mit", "mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy", "without fee")),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "mit-body",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "merchantability fitness for a particular purpose"),
    ),
    Template(
        "isc-body",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
        ("with or without fee", "author disclaims all warranties"),
    ),
    Template(
        "bsd-2-body",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "zlib-body",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
        "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("express or implied warranty", "alter it and redistribute it freely"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def licence_words(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.mandatory.values()})


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _literal(templates: tuple[Template, ...]) -> Column:
    """The templates as one value: their words and key-phrase words by place, and the latter's distinct words."""
    places = lambda items: [{"k": k, "w": w} for k, w in items]
    rows = [
        {"label": t.label, "base": t.base, "share": t.share, "keys": places(t.mandatory.items()), "own": sorted(set(t.mandatory.values())), "words": places(enumerate(t.words))}
        for t in templates
    ]
    place = "array<struct<k:int,w:string>>"
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<label:string,base:boolean,share:double,keys:{place},own:array<string>,words:{place}>>")


def _let(value: Column, body) -> Column:
    """body of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def index_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, held, postings): each file's licence words, and the places of template words if it has all of some template's licence words."""
    rows = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    rows = rows.select("id", "words", F.array_intersect("words", _texts(licence_words(templates))).alias("held"))
    wanted = F.exists(_literal(templates), lambda t: F.size(F.array_except(t["own"], F.col("held"))) == 0)
    vocabulary = sorted({w for t in templates for w in t.words})
    posting = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    none = F.from_json(F.lit("[]"), "array<struct<at:int,word:string>>")
    return rows.select("id", F.size("words").cast("long").alias("n_words"), "held", F.when(wanted, posting).otherwise(none).alias("postings"))


def document_frequencies(index: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Files that hold each licence word; as many rows reach the driver as there are such words."""
    counts = {r["word"]: r["n"] for r in index.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in licence_words(templates)}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, frequencies: dict[str, int] | None = None) -> DataFrame:
    """One row for each row of df: id, n_words, matches (label, base, start, share), by start and label."""
    index = checkpointed(index_files(df, id_col, text_col, templates))
    frequencies = document_frequencies(index, templates) if frequencies is None else frequencies
    by_idf = sorted(frequencies, key=lambda w: (frequencies[w], w))
    rows = index.withColumn("ranked", F.array_intersect(_texts(by_idf), "held"))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,label:string,base:boolean,share:double>>")
    found = F.array_sort(F.flatten(F.transform(_literal(templates), _matches)))
    return rows.select(F.col("id").alias(id_col), "n_words", F.when(F.size("postings") > 0, found).otherwise(none).alias("matches"))


def _starts(place: Column) -> Column:
    """Where a template would start for each posting of the word at that place of it."""
    return F.transform(F.filter("postings", lambda p: p["word"] == place["w"]), lambda p: p["at"] - place["k"])


def _stands(t: Column) -> Column:
    """Starts at which all key phrases stand, proposed by the file's two highest-IDF words of them."""

    def verified(own: Column) -> Column:
        rarest = F.transform(F.slice(own, 1, 2), lambda w: F.get(F.filter(t["keys"], lambda key: key["w"] == w), F.lit(0)))
        proposed = F.array_intersect(_starts(F.get(rarest, F.lit(0))), _starts(F.get(rarest, F.size(rarest) - 1)))
        starts = F.aggregate(t["keys"], proposed, lambda left, key: F.array_intersect(left, _starts(key)))
        return F.when(F.size(own) == F.size(t["own"]), starts).otherwise(F.array().cast("array<int>"))

    return _let(F.filter("ranked", lambda w: F.array_contains(t["own"], w)), verified)


def _matches(t: Column) -> Column:
    """The template's alignments in the file: for each start, the share of its words that stand right."""

    def matched(hits: Column, runs: Column) -> Column:
        share = lambda i, j: (F.coalesce(F.get(runs, j + 1), F.size(hits)) - i) / F.size(t["words"]).cast("double")
        found = F.transform(runs, lambda i, j: F.struct(F.get(hits, i).alias("start"), t["label"].alias("label"), t["base"].alias("base"), share(i, j).alias("share")))
        return F.filter(found, lambda m: m["share"] >= t["share"])

    # each start as often as words stand right for it, sorted; then where each run of equal ones begins
    hits = lambda stands: F.when(F.size(stands) > 0, F.sort_array(F.flatten(F.transform(t["words"], lambda word: F.array_intersect(stands, _starts(word)))))).otherwise(stands)
    runs = lambda hits: F.filter(F.transform(hits, lambda x, i: F.when((i == 0) | (F.get(hits, i - 1) != x), i)), lambda i: i.isNotNull())
    return _let(_let(_stands(t), hits), lambda h: _let(runs(h), lambda r: matched(h, r)))
