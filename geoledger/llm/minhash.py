"""Near-duplicate groups by min-max hashing, every link confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from geoledger.llm.common import materialize
from geoledger.llm.words import WordHashes, overlap, shingles, words
from geoledger.operators.components import connected_components

PERMUTATIONS, BANDS, ROWS = 120, 64, 8
#: Rounds in which every class tries one member of each other component that it shares buckets with.
ROUNDS = 2
#: Nodes to a row of blocks when components that meet are compared, and bytes of text.
CHUNK, CHUNK_BYTES = 256, 8 << 20
_SEED = 20_011


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def _layout() -> np.ndarray:
    """Which of the 2 * PERMUTATIONS values each band takes: every value is in two or three bands."""
    rng = np.random.default_rng(_SEED + 1)
    order = np.concatenate([rng.permutation(2 * PERMUTATIONS) for _ in range(-(-BANDS * ROWS // (2 * PERMUTATIONS)))])
    return order[: BANDS * ROWS].reshape(BANDS, ROWS)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation: two values for each hash evaluation."""
    low = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(found), 2048):
        h = found[None, i : i + 2048] * a[:, None] + b[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def _mix(values: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of values."""
    out = salt.astype(np.uint64)
    for k in range(values.shape[1]):
        out = (out ^ values[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_shingles, seq, bands, values, bytes)``: set size, digest of the word sequence, band
    keys, a byte of each signature value for cheap comparison, and the text's size. Texts without
    words have null seq, bands and values."""

    def run(batches):
        cache, (a, b), layout = WordHashes(), _multipliers(), _layout()
        salt = np.arange(1, BANDS + 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                n, seq, bands, values, size = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = words(text)
                    sets = shingles(cache.of(found), shingle)
                    n.append(len(sets)), size.append(sum(map(len, found)) + len(found))
                    if not len(sets):
                        seq.append(None), bands.append(None), values.append(None)
                        continue
                    seq.append(xxhash.xxh3_128_digest(b" ".join(found)))
                    sig = signature(sets, a, b)
                    bands.append(_mix(sig[layout], salt).astype(np.int64))
                    values.append((sig >> np.uint64(40)).astype(np.uint8).tobytes())
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.binary()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "seq", "bands", "values", "bytes"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, seq binary, bands array<bigint>, values binary, bytes bigint")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(u, v)`` whose full sets are similar enough.

    The texts of the rows in question come by two sort-merge joins; a node with very many pairs
    is split by Spark like any skewed join key.
    """
    pairs = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    pairs = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def run(batches):
        cache, sets = WordHashes(), {}

        def full(node: int, text: str) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 1024:
                    sets.clear()
                sets[node] = shingles(cache.of(words(text)), shingle)
            return sets[node]

        with np.errstate(over="ignore"):
            for batch in batches:
                keep = []
                for u, v, tu, tv in zip(*(batch.column(k).to_pylist() for k in ("u", "v", "tu", "tv")), strict=True):
                    a, b = full(u, tu), full(v, tv)
                    both = overlap(a, b)
                    keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def _agree(su: np.ndarray, sv: np.ndarray, percent: int) -> np.ndarray:
    """Where signatures agree often enough for a comparison of full sets.

    The share of 240 agreeing values has a standard deviation of at most 0.026 around a
    similarity of 0.8; the margin of 0.13 is five of them.
    """
    return (su == sv).sum(-1) * 100 >= su.shape[-1] * max(percent - 13, 1)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _promising(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(u, v)`` with like set sizes and signatures."""
    pairs = pairs.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("values").alias("su")), "u")
    pairs = pairs.join(sizes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("values").alias("sv")), "v")
    pairs = pairs.where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")

    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = _agree(_matrix(b.column("su")), _matrix(b.column("sv")), percent)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep))

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def _linked(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed ``(u, v)`` of the distinct pairs: sizes and signatures first, then full sets."""
    likely = materialize(_promising(pairs, sizes, percent), "minhash-likely")
    return materialize(_confirm(likely, texts, shingle, percent), "minhash-links")


def _merge(labels: DataFrame, between: DataFrame) -> DataFrame:
    """``labels(node, component)`` after ``between(u, v)``, links of components, joined some."""
    merged = materialize(connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("into")), "minhash-merged")
    out = labels.join(merged, "component", "left")
    return materialize(out.select("node", F.coalesce("into", "component").alias("component")), "minhash-labels")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, node, component, main, rep)``: the members of buckets that hold more than one component,
    each bucket's main component, and the first member of it in a fixed random order."""
    each = members.join(labels, "node")
    part = each.groupBy("key", "component").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node")).alias("rep"))
    main = part.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct("component", "rep"), F.struct("c", "component")).alias("m"))
    main = materialize(main.where("n > 1").select("key", F.col("m.component").alias("main"), "m.rep"), "minhash-mixed")
    return each.join(main, "key")


def _blocks(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of ``met(main, node, component)``, once for each block that they are compared in.

    All nodes met in buckets with the same main component M are compared in blocks: M's own nodes
    lie in one row of blocks each, the others (visitors) in one row and one column, about CHUNK by
    4 * CHUNK nodes and CHUNK_BYTES by 4 * CHUNK_BYTES of text to a block.
    """
    m = met.withColumn("visitor", F.col("component") != F.col("main")).join(sizes, "node")
    guests = lambda c: F.sum(F.when(F.col("visitor"), c).otherwise(0))
    grid = m.groupBy("main").agg(F.count("*").alias("all"), F.sum("bytes").alias("b"), guests(1).alias("guests"), guests(F.col("bytes")).alias("gb"))
    many = lambda n, b, k: F.ceil(F.greatest(F.col(n) / (k * CHUNK), F.col(b) / (k * CHUNK_BYTES))).cast("int")
    grid = materialize(grid.select("main", many("all", "b", 1).alias("rows"), many("guests", "gb", 4).alias("columns")), "minhash-grid")
    m = m.join(grid, "main").withColumn("h", F.xxhash64("node"))
    m = m.withColumn("row", F.pmod("h", F.col("rows")).cast("int")).withColumn("column", F.pmod(F.shiftright("h", 20), F.col("columns")).cast("int"))
    across = F.expr("transform(sequence(0, columns - 1), j -> named_struct('i', row, 'j', j, 'r', true, 'c', visitor and j = column))")
    down = F.expr("transform(filter(sequence(0, rows - 1), i -> visitor and i <> row), i -> named_struct('i', i, 'j', column, 'r', false, 'c', true))")
    m = m.withColumn("at", F.explode(F.concat(across, down)))
    return m.select("main", "at.i", "at.j", "at.r", "at.c", "node", "component", "n", "values")


def _across(mixed: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links of components ``(u, v)`` between nodes that meet in a bucket and are apart.

    Two passes over the same blocks (``_blocks``), so that no task gets a whole large group. The
    first has sizes and signatures alone and names the nodes that have a likely partner in another
    component. The second has those nodes' texts, once per block, and compares full sets; of two
    components one link per block and node is enough.
    """
    met = materialize(mixed.select("main", "node", "component").distinct(), "minhash-met", "zstd")
    blocks = materialize(_blocks(met, sizes), "minhash-blocks", "zstd")

    def likely(comp, n, values, i, r):
        at = r[(comp[r] != comp[i]) & (100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i]))]
        share = (values[at] == values[i]).sum(1)
        return at[np.argsort(-share, kind="stable")][: int(_agree(values[at], values[i], percent).sum())]

    def look(group: pa.Table) -> pa.Table:
        comp, n, res, vis = (group.column(k).to_numpy(zero_copy_only=False) for k in ("component", "n", "r", "c"))
        values, r, wanted = _matrix(group.column("values")), np.flatnonzero(res), np.zeros(group.num_rows, bool)
        for i in np.flatnonzero(vis):
            at = likely(comp, n, values, i, r)
            wanted[at] = True
            wanted[i] |= len(at) > 0
        return group.filter(pa.array(wanted))

    def run(group: pa.Table) -> pa.Table:
        comp, n, res, vis = (group.column(k).to_numpy(zero_copy_only=False) for k in ("component", "n", "r", "c"))
        values, text, cache, sets = _matrix(group.column("values")), group.column("text"), WordHashes(), {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                with np.errstate(over="ignore"):
                    sets[i] = shingles(cache.of(words(text[i].as_py())), shingle)
            return sets[i]

        r, found = np.flatnonzero(res), set()
        for i in np.flatnonzero(vis):
            linked = set()
            for k in likely(comp, n, values, i, r):
                pair = (max(comp[i], comp[k]), min(comp[i], comp[k]))
                if comp[k] not in linked and pair not in found:
                    both = overlap(full(i), full(k))
                    if 100 * both >= percent * (n[i] + n[k] - both):
                        linked.add(comp[k])
                        found.add(pair)
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    wanted = materialize(blocks.groupBy("main", "i", "j").applyInArrow(look, blocks.schema), "minhash-wanted", "zstd")
    return wanted.join(texts, "node").groupBy("main", "i", "j").applyInArrow(run, "u bigint, v bigint")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    A document's set holds the hashes of its distinct ``shingle``-word shingles (A-Z lower-cased
    words between ASCII white space); with fewer words the whole sequence is its one shingle.
    Documents whose Jaccard similarity is at least ``percent`` / 100 are linked; component_id is
    the smallest id reachable. Texts that are null, empty or blank have an empty set and no link.
    Rows with a null id can't be named: they keep component_id null and are kept. Rows that
    repeat an id are one node. An empty table gives no rows.

    1. One pass computes signatures; texts with the same word sequence are one class.
    2. A bucket's centre is its first class in a fixed random order. Every class tries the centre
       that it shares most buckets with: one pair and at most one link a class. Confirmed links are joined to components.
    3. In ROUNDS rounds, a class whose bucket holds a larger component that isn't its own tries one
       member of that. Confirmed links join components.
    4. Classes that share a bucket and are still apart are all compared across components, block
       by block (``_across``).

    A link is missed only if its texts share no band (at a similarity of exactly 0.8 a chance of
    about 1e-4, less above) or if sizes and signatures, five standard deviations off, rule it out.
    """
    rows = materialize(signatures(docs, shingle, id_col, text_col), "minhash", "zstd")
    classes = rows.where("seq is not null and doc_id is not null").groupBy("seq")
    classes = classes.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("values").alias("values"), F.first("bytes").alias("bytes"))
    classes = materialize(classes, "minhash-classes", "zstd")
    sizes = classes.select("node", "n", "values", "bytes")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("center"), F.count("*").alias("members"))
    buckets = materialize(buckets.where("members > 1"), "minhash-centers")
    shared = materialize(keyed.join(buckets, "key"), "minhash-buckets", "zstd")
    best = shared.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("c"))
    best = best.groupBy("node").agg(F.max_by("center", F.struct("c", "center")).alias("center"))
    texts = docs.select(docs[id_col].cast("long").alias("node"), docs[text_col].alias("text"))
    nodes = materialize(shared.select("node").distinct(), "minhash-nodes")
    texts = materialize(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "minhash-texts", "zstd")

    links = _linked(best.select(F.col("node").alias("u"), F.col("center").alias("v")), sizes, texts, shingle, percent)
    found = materialize(connected_components(links), "minhash-components")
    labels = materialize(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "minhash-labels")
    members = shared.select("key", "node")
    for _ in range(ROUNDS):
        tries = _mixed(members, labels).where("component <> main").groupBy("node", "component", "main", "rep").agg(F.count("*").alias("c"))
        tries = tries.groupBy("node", "component", "main").agg(F.max_by("rep", F.struct("c", "rep")).alias("rep"))
        tries = materialize(tries, "minhash-tries")
        links = _linked(tries.select(F.col("node").alias("u"), F.col("rep").alias("v")), sizes, texts, shingle, percent)
        if links.isEmpty():
            break
        between = tries.join(links, (tries["node"] == links["u"]) & (tries["rep"] == links["v"])).select(F.col("component").alias("u"), F.col("main").alias("v"))
        labels = _merge(labels, between)
    found = materialize(_across(_mixed(members, labels), sizes, texts, shingle, percent), "minhash-links")
    if not found.isEmpty():
        labels = _merge(labels, found)
    by_class = classes.select("seq", "node").join(labels, "node", "left").select("seq", F.coalesce("component", "node").alias("component"))
    by_class = materialize(by_class, "minhash-classes")
    # copies of one text may be a large share of all rows, so their class is joined as a skewed key
    out = rows.select("doc_id", "n_shingles", "seq").join(by_class, "seq", "left")
    component = F.when(F.col("seq").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each near-duplicate group, with all columns.

    Rows without an id stay; rows that repeat a kept id all stay.
    """
    gone = near_groups(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "minhash-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs, shingle=2, percent=80)
