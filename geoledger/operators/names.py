"""Scores of owner-name pairs: cleaning and TF-IDF cosine in column expressions, indel ratio in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words removed as substrings, in this order, before names are compared.
REMOVED_WORDS = (
    "llc", "farms", "trust", "tr", "trustee", "dairy", "inc", "revocable", "irrevocable", "farm", "family", "poultry", "cattle", "ranch", "acres", "land", "real", "estate", "ridge",
    "john", "fam", "partnership", "prop", "enterprises", "landowner", "lp", "llp",
)


def clean_name(name: str, literal: str = "'[^\\\\p{L}\\\\p{N}_\\\\s]'", spaces: str = "'\\\\s+'", flag: str = "") -> str:
    """SQL text: lower case, punctuation to blanks, listed words out, blanks squeezed. Null stays null."""
    text = f"regexp_replace(lower({name}), {literal}, ' '{flag})"
    for word in REMOVED_WORDS:
        text = f"replace({text}, '{word}', '')"
    return f"trim(regexp_replace({text}, {spaces}, ' '{flag}))"


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine operation a character of ``b``: bit k of
    ``row`` is 0 where the table grows at character k of ``a``."""
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for ch in b:
        here = row & places.get(ch, 0)
        row = (row + here | row - here) & full
    return len(a) - row.bit_count()


def fuzzy_score(a: str, b: str) -> int:
    """Ten times the indel ratio in whole percent (half to even); 1000 when both are empty."""
    total = len(a) + len(b)
    return 10 * round(200.0 * lcs_length(a, b) / total) if total else 1000


def with_scores(pairs: DataFrame) -> DataFrame:
    """``pairs(lo, hi)`` of distinct cleaned names with ``fuzzy``, by Arrow batches."""

    def run(batches):
        for b in batches:
            found = [fuzzy_score(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["lo", "hi", "fuzzy"])

    return pairs.select("lo", "hi").mapInArrow(run, "lo string, hi string, fuzzy bigint")


def fuzzy_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs(name_a, name_b)`` with ``fuzzy``; each unordered pair of cleaned names is scored once.

    Null names give no row. Equal cleaned names score 1000 without any table.
    """
    cleaned = pairs.where("name_a is not null and name_b is not null").distinct().withColumns({"ca": F.expr(clean_name("name_a")), "cb": F.expr(clean_name("name_b"))})
    cleaned = cleaned.withColumns({"lo": F.least("ca", "cb"), "hi": F.greatest("ca", "cb")})
    scored = with_scores(cleaned.where("lo <> hi").select("lo", "hi").distinct())
    out = cleaned.join(scored, ["lo", "hi"], "left")
    return out.select("name_a", "name_b", F.coalesce("fuzzy", F.lit(1000).cast("long")).alias("fuzzy"))


def tfidf_pairs(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(name_a, name_b)`` with ``tfidf``: truncated 1000-fold cosine over the corpus ``names(name)``.

    Distinct names are the corpus; tokens have two or more word characters; smoothed idf, L2 norm.
    A pair with no token in common scores 0, like a name without tokens. Only the given pairs meet:
    weights travel to them as one map per distinct name, and the dot product is a map look-up.
    """
    corpus = names.where("name is not null").distinct()
    words = corpus.select("name", F.explode(F.expr(r"regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]{2,}', 0)")).alias("word"))
    tf = words.groupBy("name", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    total = corpus.agg(F.count("*").alias("docs"))
    weight = tf.join(df, "word").crossJoin(F.broadcast(total)).withColumn("w", F.expr("tf * (ln((1 + docs) / (1 + df)) + 1)"))
    vectors = weight.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("vec"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    p = pairs.where("name_a is not null and name_b is not null").select("name_a", "name_b").distinct()
    p = p.join(vectors.toDF("name_a", "va", "na"), "name_a", "left").join(vectors.toDF("name_b", "vb", "nb"), "name_b", "left")
    dot = F.expr("aggregate(map_entries(va), 0D, (s, e) -> s + e.value * coalesce(vb[e.key], 0D))")
    return p.select("name_a", "name_b", F.coalesce(F.floor(dot / F.col("na") / F.col("nb") * 1000 + 1e-7), F.lit(0)).cast("long").alias("tfidf"))
