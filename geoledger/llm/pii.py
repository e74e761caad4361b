"""Personal data: fixed patterns, and terms that give protected values away."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from geoledger.llm.common import broadcast_small, materialize

# Patterns in the order of kinds. Possessive forms and the look-behinds find the same leftmost
# matches as the plain patterns in linear time; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A rough test that spares most texts the pattern.
HINTS = {"email": "@", "phone": "+"}
#: A term is disclosing when at least so many different texts have it together with one protected entity ...
SUPPORT = 3
#: ... its mutual information with the entity is at least this share of the entity's own ...
DISCLOSURE = 0.9
#: ... and fewer than this many of all tested terms would stand with it so often by chance.
CHANCE = 0.01
# A value and what it gives away besides: the names of coarser entities, as SQL over the value.
ENTITIES = {
    "email": ["lower(s.value)", "substring_index(lower(s.value), '@', 1)", "concat('@', substring_index(lower(s.value), '@', -1))"],
    "ip": ["s.value", "concat(substring_index(s.value, '.', 3), '.*')"],
    "card": ["regexp_replace(s.value, '[^0-9]', '')", "concat(left(regexp_replace(s.value, '[^0-9]', ''), 6), '*')"],
    "phone": ["concat('+', regexp_replace(s.value, '[^0-9]', ''))"],
}

_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _matches(text: str, pattern: str) -> Column:
    """Spans of a pattern (both SQL expressions), by the lengths of matches and of the gaps between."""
    gaps = f"transform(split({text}, {pattern}, -1), x -> cast(length(x) as bigint))"
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    return F.expr(f"named_struct('m', {found}, 'g', {gaps})")


def _spans(column: str) -> str:
    before = f"aggregate(slice({column}.g, 1, i + 1), 0L, (a, x) -> a + x) + aggregate(slice({column}.m, 1, i), 0L, (a, x) -> a + length(x))"
    at = f"transform(sequence(0, size({column}.m) - 1), i -> named_struct('start', {before}, 'value', element_at({column}.m, i + 1)))"
    return f"transform({at}, s -> named_struct('start', s.start, 'end', s.start + length(s.value), 'value', s.value))"


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + case when i % 2 = 1 then cast(substring(reverse({_DIGITS}), i, 1) as int)
    else 2 * cast(substring(reverse({_DIGITS}), i, 1) as int) - if(substring(reverse({_DIGITS}), i, 1) > '4', 9, 0) end) % 10 = 0"""
_KEEP = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(p, 4) as int) <= 255)",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, text, email, ip, card, phone)``: for each kind the spans (start, end, value) that pass."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    none = F.expr(f"cast(array() as {_SPAN})")
    for kind, pattern in PATTERNS.items():
        literal = "r'" + pattern + "'"
        likely = F.contains("text", F.lit(HINTS[kind])) if kind in HINTS else F.col("text").rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){15}")
        out = out.withColumn(f"_{kind}", F.when(likely, _matches("text", literal)))
        spans = F.expr(f"filter({_spans(f'_{kind}')}, s -> {_KEEP[kind]})")
        out = out.withColumn(kind, F.when(F.size(f"_{kind}.m") > 0, spans).otherwise(none))
    return out.select("row", "text", *PATTERNS)


def _terms(text: Column) -> Column:
    """Distinct lower-cased words of letters, of any length."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: w != "")


def disclosing_terms(found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(term, kind, share)`` of terms that reveal a protected value.

    ``found`` is a ``base_spans`` result of the whole corpus. A protected entity is a value, however
    it is spaced, or what it gives away of its holder (ENTITIES): an address's local part and domain, a
    network, a card's issuer. With p(v) the share of documents
    that have entity v, its information is -log2 p(v), and a term t carries
    log2(p(v | t) / p(v)) of it. A term discloses v when that is at least ``disclosure`` of v's
    information, at least ``support`` different texts have both, so chance words of single
    documents and of their exact copies don't count, and so many are no chance: by Chernoff's bound
    n * KL(share with v || p(v)) over the different texts must exceed the logarithm of the tested
    pairs over CHANCE. Words of any length are tested, in either case.

    Entities that fewer than ``support`` different texts have, most of them, are dropped by a small count before any pair
    is made. Texts are known by their digests: n copies of a text count n documents and one text (1 / n for each), so that no text is a key.
    """
    named = [F.expr(f"transform({kind}, s -> named_struct('kind', '{kind}', 'value', {e}))") for kind, es in ENTITIES.items() for e in es]
    values = F.array_distinct(F.flatten(F.array(*named)))
    texts = found.select(F.md5("text").alias("digest"), "text", values.alias("values")).where(F.size("values") > 0)
    holders = materialize(texts.groupBy("digest").agg(F.count("*").alias("copies"), F.first("values").alias("values")), "pii-holders")
    each = holders.select("digest", "copies", F.explode("values").alias("v"))
    with_value = each.groupBy("v").agg(F.sum("copies").alias("nv"), F.count("*").alias("texts")).where(F.col("texts") >= support).select("v", "nv")
    with_value = materialize(with_value, "pii-entities")
    mine = each.join(broadcast_small(with_value), "v").groupBy("digest").agg(F.first("copies").alias("copies"), F.collect_list("v").alias("vs"))
    mine = broadcast_small(materialize(mine, "pii-mine"))
    words = texts.select("digest", "text").join(mine, "digest").select("copies", F.explode("vs").alias("v"), "text")
    pairs = words.select("v", (1 / F.col("copies")).alias("part"), F.explode(_terms(F.col("text"))).alias("term"))
    counted = pairs.groupBy("v", "term").agg(F.count("*").alias("both"), F.round(F.sum("part")).cast("long").alias("texts"))
    counted = materialize(counted.where(F.col("texts") >= support), "pii-pairs")
    n, tested = found.count(), counted.count()
    if not tested:
        return counted.select("term", F.col("v.kind").alias("kind"), F.lit(0.0).alias("share"))
    # share >= disclosure means both / nt >= (nv / n) ** (1 - disclosure), and nv >= both: no pair above this bound on nt can disclose
    most = lambda both: F.pow(both, F.lit(disclosure)) * (n ** (1 - disclosure) * (1 + 1e-9))
    tried = broadcast_small(materialize(counted.groupBy("term").agg(F.max("both").alias("most")), "pii-tried"))
    everywhere = found.select(F.explode(_terms(F.col("text"))).alias("term")).join(tried, "term")
    rare = everywhere.groupBy("term").agg(F.count("*").alias("nt"), F.first("most").alias("most")).where(F.col("nt") <= most(F.col("most"))).select("term", "nt")
    rare = broadcast_small(materialize(rare, "pii-terms"))
    info = -F.log2(F.col("nv") / n)
    share = F.when(info > 0, (info + F.log2(F.col("both") / F.col("nt"))) / info).otherwise(0.0)
    q, p = F.least(F.col("both") / F.col("nt"), F.lit(1 - 1e-9)), F.least(F.col("nv") / n, F.lit(1 - 1e-9))
    luck = F.col("texts") / q * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))
    all_ = counted.join(rare, "term").where(F.col("nt") <= most(F.col("both"))).join(with_value, "v").withColumn("share", share).withColumn("luck", luck)
    all_ = all_.where((F.col("share") >= disclosure) & (F.col("luck") >= math.log(tested / CHANCE)))
    return all_.groupBy("term").agg(F.min("v.kind").alias("kind"), F.max("share").alias("share"))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, text, email, ip, card, phone, term)``: all spans of every whole text.

    Null text counts as empty and has no span. Terms are looked up in every text, by the text's
    digest, so equal texts get equal spans and repeated rows stay. An empty table gives no rows.
    Terms inside a base span are not reported again.
    """
    base = materialize(base_spans(docs, text_col).drop("text"), "pii-base", "zstd")
    base = base.select("row", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"), *PATTERNS)
    terms = materialize(disclosing_terms(base), "pii-disclosing")
    few = terms.count()
    none = F.expr(f"cast(array() as {_SPAN})")
    if not few:
        return base.withColumn("term", none)
    names = broadcast_small(terms.select("term"))
    hits = base.select(F.md5("text").alias("digest"), F.explode(_terms(F.col("text"))).alias("term")).join(names, "term", "left_semi")
    hits = materialize(hits.groupBy("digest").agg(F.array_sort(F.collect_set("term")).alias("terms")), "pii-hits")
    # the join with a large table can be split where many rows have one text
    out = base.withColumn("digest", F.md5("text")).drop("text").join(broadcast_small(hits), "digest", "left").withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))
    out = out.withColumn("pattern", F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})")))
    out = out.withColumn("_term", F.when(F.col("terms").isNotNull(), _matches("text", "pattern")))
    inside = " and ".join(f"not exists({k}, b -> b.start < s.end and s.start < b.end)" for k in PATTERNS)
    spans = F.expr(f"filter({_spans('_term')}, s -> {inside})")
    out = out.withColumn("term", F.when(F.size("_term.m") > 0, spans).otherwise(none))
    return out.select("row", "text", *PATTERNS, "term")


def sanitize(found: DataFrame) -> DataFrame:
    """``(row, sanitized)``: base spans generalised to their kind, disclosing terms removed."""
    kinds = [*PATTERNS, "term"]
    tagged = ", ".join(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'put', '{'' if k == 'term' else f'[{k.upper()}]'}'))" for k in kinds)
    step = "named_struct('out', concat(a.out, if(s.start >= a.at, concat(substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), s.put), '')), 'at', greatest(a.at, s.end))"
    folded = F.expr(f"aggregate(array_sort(concat({tagged})), named_struct('out', '', 'at', 0L), (a, s) -> {step})")
    return found.withColumn("f", folded).select("row", F.expr("concat(f.out, substring(text, cast(f.at + 1 as int)))").alias("sanitized"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # as SQL: a Python lambda of two parameters would get the element's place as the second, not the kind
    listed = lambda kinds: F.array_join(F.concat(*[F.expr(f"transform({k}, s -> concat_ws(':', '{k}', s.start, s.end))") for k in kinds]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(listed(PATTERNS), 256).alias("base_sha256"), listed([*PATTERNS, "term"]).alias("spans"))
