"""URL filters: rules first, then naive Bayes on segmented host and path words."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoledger.llm.common import join_small, materialize

# Rules (host, path prefix, verdict), and words that mark an unwanted host for training.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SEEDS = ["ads", "bets", "casino", "cheap", "farm", "free", "pills", "spam", "track", "win"]
#: Seed words together count for this share of all other words, SEED_LEAST times each at least.
SEED_SHARE, SEED_LEAST = 0.5, 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or when there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host, then path) that fits, as ``host/path``, and its verdict; else null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def segmented(labels: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``(label, words)``: the most probable split of each distinct label into known words.

    ``unigrams`` is ``(word, n, own)``; ``own`` of the ``n`` come from host labels that are the
    word. A label's own occurrences don't count for the label as one word, however frequent it
    is: it has ``n - own``, and at least the chance of a new word, which depends on its length
    and not on the table's size.

    Every substring that is as long as some known word is looked up in the unigram table by a join, so
    neither table is broadcast or capped; then one pass of Viterbi per label picks the split.
    Unknown stretches cost per character what a word never seen would.
    """
    total = unigrams.agg(F.sum("n")).first()[0] or 1
    sizes = sorted(r[0] for r in unigrams.where("word <> ''").select(F.length("word")).distinct().collect())  # a row a length
    each = f"filter(array({', '.join(map(str, sizes)) or '0'}), k -> k > 0 and k <= length(label) - i + 1)"
    starts = F.expr(f"explode(flatten(transform(sequence(1, length(label)), i -> transform({each}, k -> named_struct('i', i, 'k', k)))))")
    parts = labels.where("length(label) > 0").select("label", starts.alias("s")).select("label", "s.i", "s.k", F.expr("substring(label, s.i, s.k)").alias("word"))
    known = parts.join(unigrams, "word").groupBy("label").agg(F.collect_list(F.struct("i", "k", F.when(F.col("word") == F.col("label"), F.col("n") - F.col("own")).otherwise(F.col("n")).alias("n"))).alias("parts"))
    known = labels.join(known, "label", "left")

    def run(batches):
        for b in batches:
            out = []
            for label, options in zip(b.column("label").to_pylist(), b.column("parts").to_pylist(), strict=True):
                ends: list[list[tuple[int, float]]] = [[] for _ in range(len(label) + 1)]
                for o in options or []:
                    if o["n"]:
                        ends[o["i"] - 1 + o["k"]].append((o["i"] - 1, math.log(o["n"] / total)))
                ends[-1].append((0, -12.0 - len(label)))
                best, back = [0.0], [0]
                for e in range(1, len(label) + 1):
                    one = (best[e - 1] - math.log(total) - 12.0, e - 1)
                    score, start = max([one, *((best[s] + w, s) for s, w in ends[e])])
                    best.append(score), back.append(start)
                words, e, loose = [], len(label), ""
                while e:
                    s = back[e]
                    piece = label[s:e]
                    if any(x == s for x, _ in ends[e]):
                        words += [loose, piece] if loose else [piece]
                        loose = ""
                    else:
                        loose = piece + loose
                    e = s
                out.append([w for w in ([*words, loose] if loose else words)][::-1])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return known.select("label", "parts").mapInArrow(run, "label string, words array<string>")


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, seeds=SEEDS) -> DataFrame:
    """``(row, host, path, rule, words, log_odds, verdict)`` for every row.

    A word counts once in each distinct dotted part of a host and in each distinct URL whose path
    has it and whose host doesn't; seed words have a share of that total besides. So neither
    repeated rows nor a frequent host make a word of a label that is several. Naive Bayes
    learns from all distinct hosts: a host with a seed word among its segments is an example of
    what to block, any other of what to allow, each with all its segments and path tokens. A URL
    is blocked by the method when its words' log odds are above 0. The longest rule overrides.

    Null URLs and those without ``://`` have empty host and path, no words and verdict allow.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    host, path = url_parts(pages[url_col])
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    # one row a distinct host and path: what repeats is counted before anything is exploded
    urls = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    labels = F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    foreign = urls.select(F.explode(F.array_except(_tokens(F.col("path")), labels)).alias("word"), F.lit(0).alias("own"))
    parts = urls.select("host").distinct().select(F.explode(F.split("host", "[.]")).alias("part")).distinct()
    tokens = foreign.union(parts.select(F.explode(F.array_distinct(_tokens(F.col("part")))), F.lit(1))).where("length(word) > 1")
    tokens = materialize(tokens.groupBy("word").agg(F.count("*").alias("n"), F.sum("own").alias("own")), "url-tokens")
    each_seed = max(SEED_LEAST, int((tokens.agg(F.sum("n")).first()[0] or 0) * SEED_SHARE / max(len(seeds), 1)))
    extra = pages.sparkSession.createDataFrame([(w, each_seed, 0) for w in seeds], "word string, n bigint, own bigint")
    unigrams = materialize(tokens.union(extra).groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own")), "url-words")
    hosts = urls.select("host").distinct().withColumn("label", F.explode(labels))
    split = segmented(hosts.select("label").distinct(), unigrams)
    by_host = hosts.join(split, "label").groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("host_words"))
    by_host = materialize(by_host.withColumn("bad", F.arrays_overlap("host_words", F.array(*[F.lit(s) for s in seeds]))), "url-hosts")
    full = urls.join(by_host, "host", "left").withColumn("words", F.concat(F.coalesce("host_words", F.expr("cast(array() as array<string>)")), _tokens(F.col("path"))))
    full = materialize(full.select("host", "path", "words", F.coalesce("bad", F.lit(False)).alias("bad"), "n"), "url-full")
    seen = full.select(F.explode("words").alias("word"), "bad").groupBy("word").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a"))
    seen = materialize(seen, "url-counts")
    t = seen.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count("*")).first()
    odds = seen.select("word", (F.log((F.col("b") + 1) / (t[1] + t[2] + 1)) - F.log((F.col("a") + 1) / (t[0] + t[2] + 1))).alias("w"))
    c = full.agg(F.count_if("bad"), F.count("*")).first()
    prior = math.log((c[0] + 1) / (c[1] - c[0] + 1))
    each = full.select("host", "path", F.explode_outer("words").alias("word")).where("word is not null")
    scored = join_small(each, materialize(odds, "url-odds"), ["word"], F.xxhash64("host", "path")).groupBy("host", "path").agg((F.sum("w") + prior).alias("log_odds"))
    scored = materialize(full.select("host", "path", "words").join(scored, ["host", "path"], "left"), "url-scores")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(scored, ["host", "path"])
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return out.select("row", "host", "path", rule.alias("rule"), "words", F.coalesce("log_odds", F.lit(0.0)).alias("log_odds"), F.coalesce(verdict, method).alias("verdict"))


def op4_urls(spark, sf_dir: str) -> DataFrame:
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
