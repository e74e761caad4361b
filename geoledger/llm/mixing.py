"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from geoledger.llm.common import join_small, materialize

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """One row per source: (source, source_size, weight, target).

    ``sizes`` has (source, size). Sources stand in code-point order, null last, and take
    ``weights`` in turn. Together they get ``share`` of all sizes, in proportion to their weights;
    a source stops at ``max_repeat`` times its own size and what it can't take goes to the others
    by weight. That water level has a closed form: with sources ordered by cap/weight, the level
    after filling the first k caps rises while the next source is still capped and falls after,
    so the largest of these levels is the final one.

    One row per source is all that the global windows here see; an empty input gives no row.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    each = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(each, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size").cast("double") * max_repeat
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    per = per.withColumn("level", (total * share - before) / rest)
    per = per.withColumn("level", F.max("level").over(W.partitionBy()))
    return per.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document goes into the mix.

    Returns ``(row, size, source_size, target, copies, taken)``; ``row`` is a struct of all input
    columns, so extra columns can't clash. A document is taken floor(rate) times, rate being its
    source's target over its source's size, plus once more when a uniform number hashed from the
    seed and its id falls below the fraction. Reruns agree at any partitioning.

    Null sources are a source of their own, last in order; null and empty texts have size 0; a
    source of size 0 has target 0 and its documents are not taken; rows without an id are drawn
    by their text. Repeated rows are drawn alike. An empty table gives an empty result.

    The documents are read twice and never shuffled: once for a partial sum per source, once for
    the copies. The table of sources is broadcast only when counted small (``join_small``).
    """
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[source_col].cast("string").alias("source"),
        n_words(docs[text_col]).alias("size"),
        F.coalesce(docs[id_col].cast("string"), F.md5(F.coalesce(docs[text_col], F.lit("")))).alias("draw"),
    )
    targets = source_targets(keyed.select("source", "size"), weights, share, max_repeat)
    targets = materialize(
        targets.select(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0"), "source_size", "target"), "mix"
    )
    keyed = keyed.withColumn("k", F.coalesce("source", F.lit(""))).withColumn("k0", F.col("source").isNull())
    out = join_small(keyed, targets, ["k", "k0"], F.xxhash64("draw"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw"))), 1, 12), 16, 10).cast("double")
    out = out.withColumn("rate", rate)
    extra = (bits / float(2**48) < F.col("rate") - F.floor("rate")).cast("long")
    out = out.withColumn("copies", F.floor("rate").cast("long") + extra)
    return out.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of a ``mix`` result, each as often as it is taken, with their own columns."""
    seen = F.explode(F.expr("sequence(1L, copies)"))
    return mixed.where("copies > 0").select("row", seen.alias("_copy")).select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (
  select doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(doc_id::varchar, md5(coalesce(text, ''))) as draw
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight,
             source_size::double * 2.0::double as cap from s),
l as (select *, (sum(source_size) over ())::double * 1.5::double as goal,
             coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as before,
             sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as rest
      from w),
t as (select source, source_size, least(cap, weight * (max((goal - before) / rest) over ())) as target from l),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
             ('0x' || substr(md5('mix-1:' || d.draw), 1, 12))::bigint::double / 281474976710656.0::double as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(rate)::bigint + (u < rate - floor(rate))::int::bigint) * size as taken from r
"""
