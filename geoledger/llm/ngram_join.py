"""Jaccard join of n-gram sets: subsets of small sets, inverted lists of large ones, the boundary chosen by cost."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from geoledger.llm.common import broadcast_small, materialize
from geoledger.llm.minhash import _confirm, _merge, _mixed
from geoledger.llm.words import WordHashes, overlap, shingles, words
from geoledger.operators.components import connected_components

#: Largest set that may count as small. Its subsets are enumerated only if that is cheaper.
SMALL = 24
#: A list longer than this is long: its token goes to the end of the order of tokens, if it is among the HOT_TOKENS most frequent (8 MB).
LONG, HOT_TOKENS = 128, 1 << 20
#: Members kept beyond a set's prefix, to stand in for tokens that go to the end; a set with more of those is taken from its text anew.
SPARE = 16
#: Members of a part of what is compared, and bytes of their texts; parts are compared two by two.
PART, PART_BYTES = 1024, 8 << 20
#: Pairs of list members looked at in one step of a task.
STEP = 1 << 20
#: Rounds in which a set whose list holds another component tries one member of that.
ROUNDS = 2


def needed(n: int, m: int, percent: int) -> int:
    """Common members that make sets of these sizes similar enough: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """All numbers of common members that a set of ``n`` needs with some partner."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for m in partners if (c := needed(n, m, percent)) <= min(n, m)})


def prefix_length(n, percent: int):
    """So many first members of a set of ``n`` that any similar set has one of them among its own, in any common order."""
    return n + percent * n // -100 + 1


def subset_keys(found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, key, key): every subset of every size c that a set needs, by two sums of its members' hashes (128 bits)."""
    again = (found ^ found >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    size, first, second = [], [], []
    for c in subset_sizes(len(found), percent):
        without = np.array(list(combinations(range(len(found)), len(found) - c)), np.int64).reshape(comb(len(found), c), -1)
        size.append(np.full(len(without), c))
        for out, h in ((first, found), (second, again)):
            out.append(h.sum(dtype=np.uint64) - h[without].sum(1, dtype=np.uint64))
    return np.concatenate(size), np.concatenate(first).astype(np.int64), np.concatenate(second).astype(np.int64)


def sketch(found: np.ndarray) -> bytes:
    """Parities of a set's members by their low bits, at least one bit a member.

    Two sets differ in at least as many members as their sketches differ in bits; the halves of
    a sketch, added, are the sketch of half the size.
    """
    bits = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _one_row_an_id(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text)`` with the smallest text of each id, and ``(doc_id, copies)`` of ids that have several rows."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").cast("int").alias("copies"))
    twice = materialize(twice.where("copies > 1"), "ngram-twice")
    if twice.isEmpty():
        return docs, twice
    least = docs.join(twice, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(twice, "doc_id", "left_anti").unionByName(least), twice


def sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(doc_id, n, digest, head, sketch)``: size of a document's set, its digest, its smallest hashes (SPARE more than
    ``prefix_length``, all if at most SMALL), and its sketch. Without words all but n are null."""

    def run(batches):
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                n, cols = [], ([], [], [])
                for text in batch.column(1).to_pylist():
                    found = shingles(cache.of(words(text)), shingle)
                    n.append(len(found))
                    row = (None, None, None)
                    if len(found):
                        head = found[: max(SMALL, SPARE + prefix_length(len(found), percent))].astype(np.int64)
                        row = (xxhash.xxh3_128_digest(found.tobytes()), head, sketch(found))
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                kinds = [pa.binary(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n", "digest", "head", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, head array<bigint>, sketch binary")


def choose_boundary(cost: dict[int, tuple[int, int]], percent: int) -> int:
    """The size up to which sets count as small, so that all is cheapest.

    ``cost`` has, by size, the number of sets and the entries of the lists that they would scan. A
    subset costs one row, an entry of a list one look. A size without sets costs nothing.
    """
    total, best, at = 0, 0, 0
    for n in range(1, SMALL + 1):
        count, scanned = cost.get(n, (0, 0))
        total += count * sum(comb(n, c) for c in subset_sizes(n, percent)) - scanned
        if total <= best:
            best, at = total, n
    return at


def small_links(classes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """``(u, v)``: links of sets of at most ``boundary`` members, enough to connect all that are similar.

    Sets of n and m members are similar if they share a subset of ``needed(n, m)`` members. Of those
    with one subset of c members, the smallest one, n0, is similar to every other with n0 + m as small
    as c asks for; a larger one is similar to none by this subset. So a star is enough.
    """

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                for node, n, own in zip(b.column(0), b.column(1), b.column(2), strict=True):
                    c, k1, k2 = subset_keys(own.values.to_numpy().astype(np.uint64), percent)
                    fixed = [pa.array(np.full(len(c), x.as_py())) for x in (node, n)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(c), pa.array(k1), pa.array(k2)], ["node", "n", "c", "k1", "k2"])

    small = classes.where(F.col("n") <= boundary).select("node", "n", "head")
    keyed = materialize(small.mapInArrow(run, "node bigint, n bigint, c bigint, k1 bigint, k2 bigint"), "ngram-subsets", "zstd")
    key = ["c", "k1", "k2"]
    stars = keyed.groupBy(*key).agg(F.min(F.struct("n", "node")).alias("s"), F.count("*").alias("members")).where("members > 1").drop("members")
    similar = F.expr(f"node <> s.node and {percent} * (n + s.n) <= {100 + percent} * c")
    return keyed.join(stars, key).where(similar).select(F.col("node").alias("u"), F.col("s.node").alias("v")).distinct()


def _order(found: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the order in which the tokens ``last`` (sorted) stand at the end, and how many stand before them."""
    if not len(last):
        return found, len(found)
    is_last = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
    return np.concatenate([found[~is_last], found[is_last]]), int(len(found) - is_last.sum())


def _postings(nodes: list[int], found: list[np.ndarray], last: np.ndarray, length: list[int]) -> pa.RecordBatch:
    """Rows (node, key, new) of the prefixes of sorted sets, or as much of these as holds the prefix."""
    keys = [_order(x, last)[0][:k] for x, k in zip(found, length, strict=True)]
    new = [k > x[n - 1] for k, x, n in zip(keys, found, length, strict=True) if n]
    node = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
    flat = np.concatenate([np.zeros(0, np.uint64), *keys]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(flat), pa.array(np.concatenate([np.zeros(0, bool), *new]))], ["node", "key", "new"])


def prefixes(classes: DataFrame, hot, percent: int, known: bool) -> DataFrame:
    """``(node, key, new)``: prefixes in the order in which the tokens ``hot`` stand last, of the ``classes(node, n, head)`` whose heads
    hold them (``known``), or else the nodes of the other classes, with a null key. ``new`` tokens are in no prefix
    of the set in the order of hashes."""

    def run(batches):
        last = hot.value
        for batch in batches:
            nodes, found, length = [], [], []
            for node, n, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own, k = head.values.to_numpy().astype(np.uint64), prefix_length(n, percent)
                if known == (len(own) == n or _order(own, last)[1] >= k):
                    nodes.append(node), found.append(own), length.append(k)
            if known:
                yield _postings(nodes, found, last, length)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.bool_())], ["node", "key", "new"])

    return classes.select("node", "n", "head").mapInArrow(run, "node bigint, key bigint, new boolean")


def prefixes_of_texts(texts: DataFrame, hot, shingle: int, percent: int) -> DataFrame:
    """``(node, key, new)``: the same from ``texts(node, text)``."""

    def run(batches):
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [shingles(cache.of(words(text)), shingle) for text in batch.column(1).to_pylist()]
                yield _postings(batch.column(0).to_pylist(), found, hot.value, [prefix_length(len(x), percent) for x in found])

    return texts.select("node", "text").mapInArrow(run, "node bigint, key bigint, new boolean")


def _apart(s: bytes, t: bytes) -> int:
    """In how many bits two sketches differ, the larger one folded to the size of the smaller."""
    s, t = sorted((s, t), key=len)
    x = int.from_bytes(t, "little")
    for half in (4 * len(t) >> k for k in range((len(t) // len(s)).bit_length() - 1)):
        x = x & (1 << half) - 1 ^ x >> half
    return (int.from_bytes(s, "little") ^ x).bit_count()


def _folded(column: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
    """Sketches of ``size`` bytes as rows of 64-bit words; those of twice that size are folded."""
    out = np.zeros((len(at), size // 8), np.uint64)
    for row, k in zip(out, at.tolist(), strict=True):
        x = np.frombuffer(column[k], np.uint64)
        row[:] = x if x.nbytes == size else x[: len(row)] ^ x[len(row) :]
    return out


def similar_pairs(group: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, sketches: list[bytes], percent: int):
    """Places (u, v) of pairs of one group and of different components whose sizes and sketches don't rule a link out.

    ``side`` is 0 or 1 for the two parts of a list that are compared, -1 where there is one part. Pairs are made
    in steps of about STEP, a row's partners at once.
    """
    bytes_ = np.array([len(x) for x in sketches])
    for size in np.unique(bytes_).tolist():
        at = np.flatnonzero((bytes_ == size) | (bytes_ == 2 * size))
        at = at[np.lexsort((n[at], group[at]))]
        matrix, own = _folded(sketches, at, size), bytes_[at] == size
        wide = int(n[at].max()) + 1
        key = group[at] * wide + n[at]
        ends = np.searchsorted(key, group[at] * wide + np.minimum(100 * n[at] // percent, wide - 1), side="right")
        many = np.maximum(ends - np.arange(len(at)) - 1, 0)
        total, i = np.cumsum(many), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, side="right")))
            u = np.repeat(np.arange(i, j), many[i:j])
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j])
            x, y = at[u], at[v]
            keep = (own[u] | own[v]) & (component[x] != component[y]) & ((side[x] < 0) | (side[x] != side[y]))
            u, v, x, y = u[keep], v[keep], x[keep], y[keep]
            both = n[x] + n[y]
            near = np.zeros(len(u), np.int64)
            for k in range(matrix.shape[1]):
                near += np.bitwise_count(matrix[u, k] ^ matrix[v, k])
            keep = near <= both - 2 * -(-percent * both // (100 + percent))
            yield x[keep], y[keep]
            i = j


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(u, v)`` that sizes and sketches don't rule out."""
    for x in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    pairs = pairs.where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")

    def run(batches):
        for b in batches:
            keep = [_apart(s, t) <= n + m - 2 * needed(n, m, percent) for n, m, s, t in zip(*(b.column(k).to_pylist() for k in ("nu", "nv", "su", "sv")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def _groups(members: DataFrame, part_bytes: str | None = None) -> DataFrame:
    """``members(main, node, ...)`` once for each group (main, i, j) that they are compared in, in sorted partitions.

    All that met in lists with one main component is cut into parts of about PART by hash (and of about PART_BYTES, if a column of
    bytes is named); a group is one part or two, so a task holds at most about 2 * PART rows at once.
    """
    size = F.count("*") / PART if part_bytes is None else F.greatest(F.count("*") / PART, F.sum(part_bytes) / PART_BYTES)
    parts = members.groupBy("main").agg(F.ceil(size).cast("int").alias("parts"), F.count_distinct("component").alias("several")).where("several > 1").drop("several")
    m = members.join(parts, "main").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    m = m.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    rest = [c for c in members.columns if c != "main"]
    m = m.select("main", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"), *rest)
    return m.repartition("main", "i", "j").sortWithinPartitions("main", "i", "j")


def _whole_groups(batches):
    """Tables of whole groups and the groups' numbers in them; the last group of a batch may go on in the next one."""

    def numbered(rows: pa.Table):
        keys = [rows.column(k).to_numpy() for k in ("main", "i", "j")]
        return rows, np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))

    held = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not rows.num_rows:
            continue
        last = np.all([rows.column(k).to_numpy() == rows.column(k)[-1].as_py() for k in ("main", "i", "j")], axis=0)
        cut = int(np.argmax(last))
        if cut:
            yield numbered(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield numbered(held)


def _pairs(rows: pa.Table, group: np.ndarray, percent: int):
    component, n, side, i, j = (rows.column(k).to_numpy() for k in ("component", "n", "side", "i", "j"))
    return similar_pairs(group, n, component, np.where(i == j, -1, side), rows.column("sketch").to_pylist(), percent)


def _partnered(met: DataFrame, percent: int) -> DataFrame:
    """``(main, node)``: those of ``met(main, node, component, n, sketch)`` with a likely partner in another component."""

    def run(batches):
        for rows, group in _whole_groups(batches):
            wanted = np.zeros(rows.num_rows, bool)
            for u, v in _pairs(rows, group, percent):
                wanted[u] = wanted[v] = True
            yield from rows.select(["main", "node"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    return _groups(met).mapInArrow(run, "main bigint, node bigint").distinct()


def _between(wanted: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links of components ``(u, v)`` among ``wanted(main, node, component, n, sketch, text)``: full sets are
    compared, and of two components one link a group is enough."""

    def run(batches):
        cache = WordHashes()
        for rows, group in _whole_groups(batches):
            component, text, found, sets_ = rows.column("component").to_numpy(), rows.column("text"), set(), {}

            def full(k: int) -> np.ndarray:
                if k not in sets_:  # noqa: B023
                    with np.errstate(over="ignore"):
                        sets_[k] = shingles(cache.of(words(text[k].as_py())), shingle)  # noqa: B023
                return sets_[k]  # noqa: B023

            at = -1
            for us, vs in _pairs(rows, group, percent):
                for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                    if group[u] != at:  # pairs come group by group: the sets of one are enough
                        at, sets_ = group[u], {}
                    pair = (max(component[u], component[v]), min(component[u], component[v]))
                    if pair not in found:
                        a, b = full(u), full(v)
                        both = overlap(a, b)
                        if 100 * both >= percent * (len(a) + len(b) - both):
                            found.add(pair)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

    return _groups(wanted, "bytes").drop("bytes").mapInArrow(run, "u bigint, v bigint").distinct()


def _lists(classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, int]:
    """(``(node, key)``: the inverted lists with at least two members, the boundary).

    First all prefixes in the order of hashes are counted. Tokens of long lists are then put at the end of the order. Any
    order is right, as long as all sets follow it; this one keeps frequent passages out of prefixes.
    """
    spark = classes.sparkSession
    plain = classes.select("node", "n", F.explode(F.expr(f"slice(head, 1, cast(n - ceil({percent} * n / 100) + 1 as int))")).alias("key"))
    counts = materialize(plain.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "ngram-counts", "zstd")
    scanned = plain.where(F.col("n") <= SMALL).join(counts, "key", "left").groupBy("n").agg(F.count_distinct("node").alias("sets"), F.sum(F.coalesce("c", F.lit(1))).alias("looks"))
    boundary = choose_boundary({r.n: (r.sets, r.looks) for r in scanned.collect()}, percent)  # SMALL rows at most
    # sets that can be similar to a large one
    large = classes.where(F.col("n") >= -(-percent * (boundary + 1) // 100))

    hot = counts.where(F.col("c") > LONG).orderBy(F.desc("c"), "key").limit(HOT_TOKENS).select("key").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot.column("key").to_numpy().astype(np.int64).view(np.uint64)))
    shared, found = counts.select("key"), prefixes(large, hot, percent, True)
    rest = materialize(prefixes(large, hot, percent, False).select("node"), "ngram-rest")
    if len(hot.value):
        anew = prefixes_of_texts(docs.select(F.col("doc_id").alias("node"), "text").join(broadcast_small(rest), "node", "left_semi"), hot, shingle, percent)
        found = found.unionByName(materialize(anew, "ngram-anew", "zstd"))
        shared = shared.union(found.where("new").select("key")).distinct()
    found = materialize(found.select("node", "key").join(shared, "key", "left_semi"), "ngram-postings", "zstd")
    counts = found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    return materialize(found.join(counts, "key").select("node", "key"), "ngram-lists", "zstd"), boundary


def _linked(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(u, v)`` that full sets confirm; the texts of their ends are taken from ``docs`` once."""
    pairs = materialize(pairs, "ngram-pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(broadcast_small(materialize(ends, "ngram-ends")), "node", "left_semi")
    return materialize(_confirm(pairs, materialize(texts, "ngram-texts", "zstd"), shingle, percent), "ngram-links")


def jaccard_classes(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row.

    A document's set holds the (hashes of the) distinct ``shingle``-word shingles of its A-Z lower-cased words between ASCII white
    space; with fewer words the whole sequence is its one member. Documents whose sets have a Jaccard
    similarity of at least ``percent`` / 100 are linked; component_id is the smallest id reachable. Null, empty and
    blank texts have an empty set, size 0 and no link. Rows with a null id can't be named and keep component_id
    null. Of rows that repeat an id the smallest text counts, and each has its result. An empty table gives no rows.

    The join is exact; no list, partner or candidate is capped.

    1. Documents with equal sets are one class, of which the smallest id stands for all.
    2. Small sets, up to a size chosen by cost: every subset of each size that a similar pair shares is a key.
    3. Large sets, and small ones that can be similar to them, are in inverted lists of their prefixes: sets that
       are similar have a common token in the first ones of any order. Every set tries the centre of the lists that it shares most
       of, then one member of each other component, so that a large group of copies costs a few pairs a set.
    4. All that meet in lists that still hold several components are compared, in parts; sizes and parity sketches
       rule out pairs that can't be links, which leaves few sets, and full sets confirm the rest.
    """
    docs, twice = _one_row_an_id(docs, id_col, text_col)
    rows = materialize(sets(docs, shingle, percent), "ngram", "zstd")
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest")
    classes = classes.agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", "head", "sketch")))
    classes = materialize(classes, "ngram-classes", "zstd")
    lists, boundary = _lists(classes, docs, shingle, percent)
    nodes = materialize(lists.select("node").distinct(), "ngram-nodes")
    about = materialize(classes.join(nodes, "node", "left_semi").select("node", "n", "sketch"), "ngram-about", "zstd")
    linked = lambda pairs: _linked(_likely(pairs, about, percent), docs, shingle, percent)

    centers = lists.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("center"))
    shared = lists.join(centers, "key").where("node <> center").groupBy("node", "center").agg(F.count("*").alias("c"))
    best = shared.groupBy("node").agg(F.max_by("center", F.struct("c", "center")).alias("center"))
    links = linked(best.select(F.col("node").alias("u"), F.col("center").alias("v")))
    links = materialize(links.union(small_links(classes, boundary, percent)), "ngram-links")
    found = materialize(connected_components(links), "ngram-components")
    labels = nodes.union(found.select("node")).distinct().join(found, "node", "left")
    labels = materialize(labels.select("node", F.coalesce("component", "node").alias("component")), "ngram-labels")

    members = lists.select("key", "node")
    for _ in range(ROUNDS):
        tries = _mixed(members, labels).where("component <> main").groupBy("node", "component", "main", "rep").agg(F.count("*").alias("c"))
        tries = tries.groupBy("node", "component", "main").agg(F.max_by("rep", F.struct("c", "rep")).alias("rep"))
        tries = materialize(tries, "ngram-tries")
        links = linked(tries.select(F.col("node").alias("u"), F.col("rep").alias("v")).distinct())
        if links.isEmpty():
            break
        between = tries.join(links, (tries["node"] == links["u"]) & (tries["rep"] == links["v"])).select(F.col("component").alias("u"), F.col("main").alias("v"))
        labels = _merge(labels, between)
    met = _mixed(members, labels).select("main", "node", "component").distinct()
    met = materialize(met.join(about, "node"), "ngram-met", "zstd")
    wanted = materialize(_partnered(met, percent), "ngram-partnered")
    nodes = broadcast_small(materialize(wanted.select("node").distinct(), "ngram-ends"))
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi").withColumn("bytes", F.octet_length("text").cast("long"))
    wanted = wanted.join(met, ["main", "node"]).join(materialize(texts, "ngram-texts", "zstd"), "node")
    links = materialize(_between(wanted, shingle, percent), "ngram-links")
    if not links.isEmpty():
        labels = _merge(labels, links)

    by_class = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    by_class = materialize(by_class, "ngram-classes")
    # copies of one text may be a large share of all rows, so their class is joined as a skewed key
    out = rows.select("doc_id", "n", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if twice.isEmpty():
        return out
    again = out.join(twice, "doc_id", "left").withColumn("copies", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return again.drop("copies")


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` by four-word shingles at a similarity of 0.85."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
