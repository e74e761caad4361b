"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoledger.llm.common import SPACES, materialize


def digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text without ASCII white space; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), "UTF-8"), 256))


class DigestIndex:
    """A table of known digests, bucketed and sorted by digest, that grows by appending batches.

    Columns: digest, keep_id, n_chars, group_size, fresh, and the partition columns seq and batch. A
    batch has one row for each of its digests; ``fresh`` marks the batch that brought the digest in.
    Every append writes the same number of buckets, so a lookup is a sort-merge join that shuffles
    only the incoming digests, never the index. The table lives in the session's warehouse, which
    the cluster shares; one writer at a time. A session whose catalog doesn't know the name registers the table by its
    folder, with the number of buckets that a hidden file there names; so an index outlives its session.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if name and not self.exists():
            self._register()
        if self.exists():
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {self.name}").collect()}
            self.buckets = int(about["Num Buckets"])

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _folder(self, name: str = ""):
        """The table's folder or a file in it, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{self.name.lower()}{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _register(self) -> None:
        """Name in this session's catalog a table that an earlier session made."""
        path, fs = self._folder()
        found = [m for f in (fs.listStatus(path) if fs.exists(path) else []) if (m := re.fullmatch(r"_buckets_(\d+)", f.getPath().getName()))]
        if not found:
            return
        columns = ", ".join(f"{c} {t}" for c, t in self.spark.read.parquet(path.toString()).drop("seq", "batch").dtypes)
        self.spark.sql(
            f"create table {self.name} ({columns}, seq bigint, batch string) using parquet partitioned by (seq, batch) "
            f"clustered by (digest) sorted by (digest) into {found[0][1]} buckets location '{path.toString()}'"
        )
        self.spark.sql(f"msck repair table {self.name}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def batches(self) -> dict[str, int]:
        """Each batch's place in the order of appending, from the names of the table's folders."""
        found = [r[0].split("/") for r in self.spark.sql(f"show partitions {self.name}").collect()]
        return {b.partition("=")[2]: int(a.partition("=")[2]) for a, b in found}

    def append(self, groups: DataFrame, seq: int, batch: str) -> None:
        dealt = groups.repartition(self.buckets, "digest").select("*", F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch"))
        writer = dealt.write.partitionBy("seq", "batch").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.mode("append").format("parquet").saveAsTable(self.name)
        mark, fs = self._folder(f"/_buckets_{self.buckets}")
        if not fs.exists(mark):
            fs.create(mark).close()

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path, fs = self._folder()
        fs.delete(path, True)  # a table registered by its folder leaves its files


def add_batch(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against the index and within itself, then append it to the index.

    Returns ``(doc_id, digest, n_chars, keep_id, group_size, kept)`` for every row. Within the
    batch the row with the most code points stays, then the smallest id (null ids last). A digest
    the index already has keeps the row named there; group_size counts the rows of this and all earlier
    batches. ``batch`` names the batch, in letters, digits, - and _ (by default a new name): adding a batch again, as after a
    lost driver, appends nothing and returns what it returned the first time. Rows with equal text and equal id are one
    document: each of them is marked kept if that id is. Null text counts as empty. An empty
    batch returns no rows.

    Only digests and ids are shuffled. Copies are counted by partial aggregation; joining the
    verdict back is a sort-merge join whose large partitions Spark splits, except for digests that
    hold over 1/4096 of the batch, at most 4096 of them, which are broadcast.
    """
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch("[A-Za-z0-9_-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = docs.select(docs[id_col].alias("doc_id"), digest(docs[text_col]).alias("digest"), F.length(text).cast("long").alias("n_chars"))
    keys = materialize(keys, "digests")
    best = F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id"))
    groups = keys.groupBy("digest").agg(best.alias("keep_id"), F.max("n_chars").alias("n_chars"), F.count("*").alias("group_size"))
    groups = materialize(groups, "digest-groups")
    if not index.exists():
        index.append(groups.where("false").withColumn("fresh", F.lit(True)), 0, "none")
    order = index.batches()
    seq = order.get(batch, max(order.values(), default=0) + 1)
    if batch not in order:
        known = index.read().where(F.col("fresh") & (F.col("seq") < seq)).select("digest").hint("merge")
        fresh = groups.join(known, "digest", "left_anti").withColumn("fresh", F.lit(True))
        again = groups.join(known, "digest", "left_semi").withColumn("fresh", F.lit(False))
        index.append(fresh.union(again), seq, batch)
    past = index.read().where(F.col("seq") <= seq).select("digest", "keep_id", "fresh", "seq", F.col("group_size").alias("n"))
    sized = groups.select("digest", F.col("group_size").alias("here")).join(past.hint("merge"), "digest").groupBy("digest")
    sized = sized.agg(F.max_by("keep_id", "fresh").alias("keep_id"), F.sum("n").alias("group_size"), F.bool_or(F.col("fresh") & (F.col("seq") == seq)).alias("new"), F.max("here").alias("here"))
    sized = materialize(sized, "digest-verdicts")
    hot_over = max(keys.count() // 4096, 1)
    hot = sized.where(F.col("here") > hot_over)
    rest = sized.where(F.col("here") <= hot_over)
    with_hot = keys.join(F.broadcast(hot.select("digest", F.lit(True).alias("_hot"))), "digest", "left")
    parts = [
        with_hot.where("_hot").join(F.broadcast(hot), "digest"),
        with_hot.where("_hot is null").join(rest, "digest"),
    ]
    cols = ["doc_id", "digest", "n_chars", "keep_id", "group_size", (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``add_batch``. Without an index
    they are held against each other alone."""
    lasting = index or DigestIndex(docs.sparkSession)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.col("doc_id").isNull().alias("_k0"), F.col("digest").alias("_d")]
    kept = add_batch(docs, lasting, id_col, text_col, batch).where("kept").select(*key).distinct()
    if index is None:
        lasting.drop()
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("_k"), docs[id_col].isNull().alias("_k0"), digest(docs[text_col]).alias("_d"),
    )
    on = ["_k", "_k0", "_d"]
    return packed.join(kept, on, "left_semi").dropDuplicates(on).select("row.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = DigestIndex(spark)
    out = add_batch(docs, index)
    index.drop()  # the verdicts are written; a lasting index would keep its name
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
k as (select *, first_value(doc_id) over (partition by text_sha256 order by length(text) desc, doc_id) as keep_id,
             count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k
"""
