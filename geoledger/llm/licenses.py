"""License scans by exact containment join with prefix, length and positional filters."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

# Phrases and their labels, and template sentences of public licenses.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "agpl-3.0": "you should have received a copy of the gnu affero general public license along with this program",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Lines without a word, between paragraphs.
BLANK = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"


def license_words(text: Column) -> Column:
    """Words of ASCII letters (A-Z lower-cased), digits and other characters, in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def _plain(text: str) -> str:
    """A template's words by the same rule, one space between."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return " ".join(w for w in re.split(SEPARATORS, lower) if w)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def token_order(docs: DataFrame, templates: dict[str, str], text_col: str) -> list[str]:
    """The templates' tokens by rising number of documents of the whole corpus that have them."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    seen = docs.select(F.explode(F.array_intersect(_strings(vocabulary), license_words(docs[text_col]))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row a template token
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, text_col: str = "text") -> DataFrame:
    """``(row, n_words, places, matches)``: row holds all columns; ``places`` are (label, start)
    of fixed phrases by word, ``matches`` are (block, label, containment) of text blocks.

    A block is a line, a paragraph between lines without words, or a window of 5/4 of the
    template's words anywhere in the text, so wrapping doesn't matter. It matches a template when
    it has at least ``containment`` of the template's distinct tokens; it is named by its first
    line. Paragraphs and windows count where no line of theirs matches that template by itself;
    of overlapping ones the best counts, then the shortest, then the last. The join is exact: tokens are ordered by global frequency; a block
    must share one of a template's rarest |T| - need + 1 tokens (prefix), have at least ``need``
    known tokens (length), and enough must be left from the first shared token on (position);
    only then is the whole intersection counted. The templates are a parameter and the smaller
    side, held as literals; no row of the corpus is shuffled except partial counts.

    Null and empty texts have no words and no matches. Repeated rows match alike; an empty table
    gives no rows.
    """
    templates = {k: t for k, t in ((k, _plain(t)) for k, t in (TEMPLATES if templates is None else templates).items()) if t}
    order = token_order(docs, templates, text_col)
    rank = {w: k for k, w in enumerate(order)}
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    base = packed.withColumn("words", license_words(F.col("text")))
    base = base.withColumn("norm", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    places, entries, prefixes = [], [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = " and ".join(f"element_at(words, i + {k + 1}) = '{w}'" for k, w in enumerate(p))
        hits = f"transform(filter(sequence(0, size(words) - {len(p)}), i -> {here}), i -> named_struct('label', '{label}', 'start', cast(i as bigint)))"
        places.append(f"case when contains(norm, ' {phrase} ') then {hits} else cast(array() as array<struct<label:string,start:bigint>>) end")
    for label, text in templates.items():
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(containment * len(tokens) - 1e-9)
        prefix = tokens[: len(tokens) - need + 1]
        prefixes |= set(prefix)
        lits = lambda ws: "array(" + ", ".join(map(_quoted, ws)) + ")"
        entries.append(f"named_struct('label', {_quoted(label)}, 'tokens', {lits(tokens)}, 'prefix', {lits(prefix)}, 'need', {need}, 'width', {len(text.split()) * 5 // 4})")
    base = base.withColumn("places", F.expr(f"concat({', '.join(places)})")).withColumn("n_words", F.size("words").cast("long"))
    rare = _strings(sorted(prefixes))
    lines = F.when(F.arrays_overlap("words", rare), F.split(F.col("text"), "\n"))
    blocks = F.transform(lines, lambda x, k: F.struct(k.alias("block"), F.array_intersect(_strings(order), license_words(x)).alias("known")))
    base = base.withColumn("blocks", F.filter(blocks, lambda b: F.arrays_overlap(b["known"], rare)))
    first = "element_at(array_intersect(t.prefix, b.known), 1)"
    left = f"least(size(t.tokens) - array_position(t.tokens, {first}), size(b.known) - array_position(b.known, {first})) + 1"
    test = f"size(b.known) >= t.need and arrays_overlap(t.prefix, b.known) and {left} >= t.need and size(array_intersect(t.tokens, b.known)) >= t.need"
    match = f"""flatten(transform(blocks, b -> transform(filter(array({', '.join(entries)}), t -> {test}),
        t -> named_struct('block', b.block, 'label', t.label, 'containment', size(array_intersect(t.tokens, b.known)) / size(t.tokens)))))"""
    empty = "cast(array() as array<struct<block:int,label:string,containment:double>>)"
    found = F.expr(match if templates else empty)
    if not templates:
        return base.select("row", "n_words", "places", F.expr(empty).alias("matches"))
    base = base.withColumn("by_line", F.when(F.size("blocks") > 0, found).otherwise(F.expr(empty)))
    # only texts with enough of a template's tokens on more than one line are looked at in windows
    known = F.when(F.col("text").contains("\n") & F.arrays_overlap("words", rare), F.array_intersect(_strings(order), F.col("words")))
    base = base.withColumn("known", known)
    base = base.withColumn("near", F.expr(f"filter(array({', '.join(entries)}), t -> size(array_intersect(t.tokens, known)) >= t.need)"))
    some = F.size("near") > 0
    line_of = F.flatten(F.transform(F.split("text", "\n"), lambda x, k: F.array_repeat(k, F.size(license_words(x)))))
    base = base.withColumn("line_of", F.when(some, line_of)).withColumn("sizes", F.when(some, F.transform(F.split("text", BLANK), lambda x: F.size(license_words(x)))))
    paragraphs = "transform(sequence(0, size(sizes) - 1), k -> named_struct('i', aggregate(slice(sizes, 1, k), 0, (a, x) -> a + x), 'n', sizes[k]))"
    base = base.withColumn("paragraphs", F.expr(f"filter({paragraphs}, p -> p.n > 0)"))
    windows = "transform(filter(sequence(0, size(words) - 1), i -> array_contains(t.tokens, words[i])), i -> named_struct('i', i, 'n', least(t.width, size(words) - i)))"
    hits = f"transform(concat(paragraphs, {windows}), s -> named_struct('c', -size(array_intersect(t.tokens, slice(words, s.i + 1, s.n))), 'n', s.n, 'r', -s.i, 'i', s.i))"
    alone = "not exists(by_line, m -> m.label = t.label and m.block between line_of[h.i] and line_of[h.i + h.n - 1])"
    best = f"""aggregate(array_sort(filter({hits}, h -> -h.c >= t.need and {alone})), cast(array() as array<struct<c:int,n:int,r:int,i:int>>),
        (a, h) -> if(exists(a, g -> g.i < h.i + h.n and h.i < g.i + g.n), a, concat(a, array(h))))"""
    spans = F.expr(f"flatten(transform(near, t -> transform({best}, h -> named_struct('block', line_of[h.i], 'label', t.label, 'containment', -h.c / size(t.tokens)))))")
    matches = F.when(some, F.concat("by_line", F.array_distinct(spans))).otherwise(F.col("by_line"))
    return base.select("row", "n_words", "places", matches.alias("matches"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = scan_licenses(docs)
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    found, more = F.col("places.label"), F.col("matches.label")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)))
    return s.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"), named(found).alias("base_labels"), named(F.concat(found, more)).alias("labels"), score.alias("score"),
    )
