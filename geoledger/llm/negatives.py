"""Hard negatives: scores in blocks, then a secondary-sort shuffle that opens a window at each positive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoledger.llm.common import materialize

#: Anchors and rows to a block of scores on average, and scores held at once in a task.
ANCHORS, ROWS, SCORES = 4096, 8192, 1 << 20
_LONG = 2**63 - 1


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, altered: int = 7, classes: int = 10) -> DataFrame:
    """``(id, label, v)``: whole components floor(scale * x) as doubles; labels of ids divisible by ``altered`` move on by one.

    Rows with a null id, label, vector or component, or one that is not finite, drop. An id that
    repeats counts once, with its smallest (label, vector).
    """
    x = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), df[vector_col].cast("array<double>").alias("x"))
    x = x.where("id is not null and label is not null and x is not null and forall(x, c -> coalesce(abs(c) < double('infinity'), false))")
    moved = F.when(F.pmod("id", F.lit(altered)) == 0, F.pmod(F.col("label") + 1, F.lit(classes))).otherwise(F.col("label"))
    # floor() of a double is a long in SQL, and doubles from 2**52 on are whole anyway
    most = "1.7976931348623157E308D"
    x = x.select("id", moved.alias("label"), F.expr(f"transform(x, c -> if(abs({scale} * c) < 4503599627370496D, double(floor({scale} * c)), least({most}, greatest(-{most}, {scale} * c))))").alias("v"))
    return x.groupBy("id").agg(F.min(F.struct("label", "v")).alias("t")).select("id", "t.label", "t.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as int64; those beyond its range stop at its ends.

    Doubles are exact while all partial sums stay below 2**53; else Python's whole numbers are used.
    """
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    wa, wb = whole(a), whole(b)
    return np.array([[max(-_LONG - 1, min(_LONG, sum(p * q for p, q in zip(x, y, strict=True)))) for y in wb] for x in wa], np.int64).reshape(len(a), len(b))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score, then id; ties at the last score are all looked at."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], ~score[at]))[:k]]  # ~s falls as s rises, for every int64


def _in_window(score: np.ndarray, top: int, percent: int) -> np.ndarray:
    """Scores s with percent * top <= 100 * s <= 100 * top, without overflow."""
    low = -((-percent * int(top)) // 100)
    return (score >= max(low, -_LONG - 1)) & (score <= top) if low <= top else np.zeros(len(score), bool)


def _blocks(anchors: DataFrame, rows: DataFrame) -> tuple:
    """Both sides dealt to blocks (i, j): anchors once for each group of rows, rows once for each group of anchors."""
    many = lambda df, each: max(1, -(-df.count() // each))
    a, r = many(anchors, ANCHORS), many(rows, ROWS)
    group = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("i", group(a)).withColumn("j", every(r))
    right = rows.withColumn("j", group(r)).withColumn("i", every(a))
    return left.groupBy("i", "j"), right.groupBy("i", "j")


def _scored(anchors: DataFrame, rows: DataFrame, pick) -> DataFrame:
    """``(anchor, id, score)`` of what ``pick(anchor's place, table of anchors, scores, ids, labels)`` keeps of each block.

    A block meets a bounded number of anchors and rows, a stripe of its scores is held at a time.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right))
            a, b = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
            ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
            step = max(1, SCORES // len(b))
            for at in range(0, len(a), step):
                for k, s in enumerate(scores(a[at : at + step], b), at):
                    kept = pick(k, left, s, ids, labels)
                    out.append((np.full(len(kept), left.column("id")[k].as_py()), ids[kept], s[kept]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], ["anchor", "id", "score"])

    left, right = _blocks(anchors, rows)
    return left.cogroup(right).applyInArrow(run, "anchor bigint, id bigint, score bigint")


def positives(anchors: DataFrame, rows: DataFrame, first: int) -> DataFrame:
    """``(anchor, id, score)``: the ``first`` best other rows of each anchor's label; each block sends as many at most."""

    def pick(k, left, s, ids, labels):
        own = np.flatnonzero((labels == left.column("label")[k].as_py()) & (ids != left.column("id")[k].as_py()))
        return own[_first(s[own], ids[own], first)]

    found = _scored(anchors, rows, pick)
    rank = F.row_number().over(_window())
    return found.withColumn("rank", rank).where(F.col("rank") <= first).drop("rank")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("anchor").orderBy(F.desc("score"), "id")


def negatives_in_windows(anchors: DataFrame, rows: DataFrame, percent: int, first: int) -> DataFrame:
    """``(anchor, id, score)``: of each block, the ``first`` best rows of another label in each window of ``anchors.tops``."""

    def pick(k, left, s, ids, labels):
        other = np.flatnonzero(labels != left.column("label")[k].as_py())
        kept: set[int] = set()
        for top in left.column("tops")[k].as_py():
            at = other[_in_window(s[other], top, percent)]
            kept.update(at[_first(s[at], ids[at], first)].tolist())
        return np.array(sorted(kept), np.int64)

    return _scored(anchors, rows, pick)


def windows(pairs, percent: int, first: int):
    """Rows (anchor, positive, rank, negative, positive score, negative score) from pairs in the order of their keys.

    ``pairs`` are ``((anchor, -score, id), is positive)``. A positive opens a window at its score; each
    negative is emitted for the open windows that it falls in; a window closes when it is full or its
    lower end is passed. Held are the open windows and, as a positive may stand behind negatives of
    its own score, the first ``first`` negatives of the current score: never an anchor's rows.
    """
    anchor, opened, level, tied = None, [], None, []
    for (a, minus, i), is_positive in pairs:
        score = -minus
        if a != anchor:
            anchor, opened, level = a, [], None
        if score != level:
            level, tied = score, []
            opened = [w for w in opened if percent * w[1] <= 100 * score and w[2] < first]
        if is_positive:
            w = [i, score, 0]
            if percent * score <= 100 * score:
                for negative in tied:
                    w[2] += 1
                    yield a, i, w[2], negative, score, score
                opened.append(w)
            continue
        if len(tied) < first:
            tied.append(i)
        for w in opened:
            if w[2] < first:
                w[2] += 1
                yield a, w[0], w[2], i, w[1], score


def _spread(key: tuple) -> int:
    """Partition of a key: anchors are often multiples of a round number, so their bits are mixed."""
    return ((key[0] & (1 << 64) - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 24


def hard_negatives(anchors: DataFrame, rows: DataFrame, positives_each: int = 5, first: int = 5, percent: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` and ``rows`` are of the form that ``vectors`` gives, with unique ids. A row's score is
    its whole-number inner product with the anchor (missing components count as 0; beyond 64 bits it stops at the range's end);
    higher scores come first, ties by smaller id. For each of an anchor's first ``positives_each`` other
    rows of its label, the ``first`` best rows of another label with percent * positive score
    <= 100 * score <= 100 * positive score are returned. An anchor without positives, or a positive
    without such rows, has no row; so has an empty table.

    Scores are made in blocks, twice: once for the positives, once, with the windows known, for
    the negatives. A block sends only pairs that can be in the result, at most ``first`` a window. They are
    packed into keys (anchor, -score, id), dealt out by anchor and sorted within partitions by the
    shuffle; ``windows`` then streams over them.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "negatives-rows", "zstd")
    anchors = materialize(anchors, "negatives-anchors", "zstd")
    best = materialize(positives(anchors, rows, positives_each), "negatives-positives")
    tops = best.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_set("score")).alias("tops"))
    found = negatives_in_windows(anchors.join(tops, "id"), rows, percent, first)

    pairs = best.withColumn("positive", F.lit(True)).union(found.withColumn("positive", F.lit(False)))
    keyed = pairs.rdd.map(lambda r: ((r[0], -r[2], r[1]), r[3]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, _spread)
    out = ordered.mapPartitions(lambda p: windows(p, percent, first))
    return spark.createDataFrame(out, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint", verifySchema=False)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100) among all rows of ``embeddings``."""
    rows = materialize(vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "negatives-vectors", "zstd")
    return hard_negatives(rows.where("id % 100 = 0"), rows)


OP13_SQL = """with r as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
  s as (select a.id as anchor, a.label = r.label as same, r.id, cast(list_inner_product(a.v, r.v) as bigint) as score from r a join r on r.id <> a.id where a.id % 100 = 0),
  p as (select anchor, id, score from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5),
  n as (select p.anchor, p.id as positive, p.score as ps, s.id, s.score, row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as k
    from p join s on s.anchor = p.anchor and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor as anchor_id, positive as positive_id, cast(k as int) as rank, id as negative_id, ps as positive_score, score as negative_score from n where k <= 5"""
