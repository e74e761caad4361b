"""Toxicity from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from geoledger.llm.common import materialize
from geoledger.llm.tokens import slices

#: Bound on the labelled rows that the model is fitted on: the first by a hash of their id.
EXAMPLES = 6_000
#: Neighbours that vote, examples to an index block, queries that are scored at once.
NEIGHBOURS, SPAN, QUERIES = 15, 512, 128
#: Weight of a term that says nothing about the label, and of one for each standard deviation over EVIDENCE that its share of label 1 is off.
FLOOR, EVIDENCE = 0.1, 3.0
#: A text counts as toxic from this score on.
THRESHOLD = 0.5
#: Digits of a cosine that count; equal ones are ties.
_UNIT = 10**12

_WORD = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, term, count) for each text's distinct terms, and the terms by number.

    Terms are runs of letters, digits and non-ASCII characters of the whole lower-cased text; null
    counts as empty.
    """
    plain = [(t or "").lower().encode().translate(_WORD) for t in texts.to_pylist()]
    cut = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    owner = np.repeat(np.arange(len(plain)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    keys, counts = np.unique(owner * max(len(words), 1) + coded.indices.to_numpy(), return_counts=True)
    text, term = np.divmod(keys, max(len(words), 1))
    if "" in words:  # white space at a text's ends
        some = term != words.index("")
        text, term, counts = text[some], term[some], counts[some]
    return text, term, counts, words


@dataclass
class _Block:
    """Postings of SPAN examples: for each term that they have, its largest weight and its examples."""

    terms: np.ndarray
    most: np.ndarray
    start: np.ndarray
    length: np.ndarray
    examples: np.ndarray
    weights: np.ndarray

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        return at, self.terms[at] == term


class BlockMaxIndex:
    """Inverted index over example vectors with the largest weight of each term in each block.

    Given are (example, term, weight) entries; examples should be numbered so that like ones share
    blocks of SPAN. A query takes blocks by falling upper bound, query weight times block maximum summed over its terms,
    scores each fully, and leaves out a block whose bound is below the score of its current k-th neighbour.
    The result is exact; ties go to the smaller example number.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int):
        self.n, self.bits, self.blocks = n, max(n.bit_length(), 1), []
        for b in range(-(-n // SPAN)):
            here = np.flatnonzero(example // SPAN == b)
            here = here[np.lexsort((example[here], term[here]))]
            terms, start, length = np.unique(term[here], return_index=True, return_counts=True)
            most = np.maximum.reduceat(weight[here], start) if len(here) else np.zeros(0)
            self.blocks.append(_Block(terms, most, start, length, example[here] - b * SPAN, weight[here]))

    def search(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``k`` examples of largest cosine over 0 with each of ``n`` queries,
        best first; -1 and 0 where there are fewer. Entries are sorted by query."""
        parts = [self._search(query[a:b] - i, term[a:b], weight[a:b], min(QUERIES, n - i), k) for i in range(0, n, QUERIES) for a, b in [np.searchsorted(query, [i, i + QUERIES])]]
        keys = np.concatenate(parts) if parts else np.zeros((0, k), np.int64)
        found = keys > 0
        return np.where(found, (1 << self.bits) - 1 - (keys & (1 << self.bits) - 1), -1), (keys >> self.bits) / _UNIT

    def _search(self, query, term, weight, n, k) -> np.ndarray:
        best = np.zeros((n, k), np.int64)
        places, bounds = [], np.zeros((n, len(self.blocks)))
        for b, block in enumerate(self.blocks):
            at, hit = block.find(term) if len(block.terms) else (np.zeros(len(term), np.int64), np.zeros(len(term), bool))
            places.append((at, hit))
            bounds[:, b] = np.bincount(query[hit], weight[hit] * block.most[at[hit]], n)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for r in range(len(self.blocks)):
            for b in np.unique(order[:, r]):
                needed = (bounds[:, b] + 2 / _UNIT) * _UNIT >= (best.min(1) >> self.bits)
                live = (order[:, r] == b) & (bounds[:, b] > 0) & needed
                if live.any():
                    rows = np.flatnonzero(live)
                    best[rows] = self._score(int(b), rows, live, query, weight, *places[b], best[rows])
        return -np.sort(-best, axis=1)

    def _score(self, b, rows, live, query, weight, at, hit, best) -> np.ndarray:
        """The best keys (rounded cosine, then small example number) with those of block ``b``."""
        block, place = self.blocks[b], np.zeros(len(live), np.int64)
        place[rows] = np.arange(len(rows))
        use = np.flatnonzero(hit & live[query])
        length = block.length[at[use]]
        ends = np.cumsum(length)
        where = np.arange(int(ends[-1])) + np.repeat(block.start[at[use]] - ends + length, length)
        cell = np.repeat(place[query[use]] * SPAN, length) + block.examples[where]
        score = np.bincount(cell, np.repeat(weight[use], length) * block.weights[where], len(rows) * SPAN).reshape(-1, SPAN)
        keys = np.rint(score * _UNIT).astype(np.int64) << self.bits
        keys = np.where(keys > 0, keys | (1 << self.bits) - 1 - (b * SPAN + np.arange(SPAN)), 0)
        both = np.concatenate([best, keys], axis=1)
        return np.partition(both, both.shape[1] - best.shape[1], axis=1)[:, -best.shape[1] :]


@dataclass
class Model:
    """Everything a task needs; its size is bounded by the EXAMPLES texts."""

    vocabulary: pa.Array
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    index: BlockMaxIndex
    prior: float
    curve: list[tuple[float, float]] = field(default_factory=list)

    def numbers(self) -> dict[str, int]:
        return dict(zip(self.vocabulary.to_numpy(zero_copy_only=False).tolist(), range(len(self.vocabulary)), strict=True))

    def vectors(self, texts: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) entries of unit vectors over the vocabulary, sorted by text."""
        text, term, count, words = term_counts(texts)
        known = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
        term = known[term] if len(words) else term
        text, term, count = (x[term >= 0] for x in (text, term, count))
        return text, term, unit(text, (1 + np.log(count)) * self.weight[term], len(texts))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each weighing the inverse of its distance; the prior
        share stands for one more neighbour at distance 1."""
        if not len(self.labels):
            return np.full(len(found), self.prior)
        w = np.where(found >= 0, 1 / (0.05 + 1 - np.minimum(cosine, 1.0)), 0.0)
        return ((w * self.labels[found]).sum(1) + self.prior) / (w.sum(1) + 1)

    def score(self, texts: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, examples, cosines) of whole texts; equal texts are searched once."""
        coded = pc.fill_null(texts, "").dictionary_encode()
        found, cosine = self.index.search(*self.vectors(coded.dictionary, numbers), len(coded.dictionary), NEIGHBOURS)
        raw = self.vote(found, cosine)
        if self.curve:
            raw = np.where(found[:, 0] >= 0, np.interp(raw, [x for x, _ in self.curve], [y for _, y in self.curve]), raw)
        at = coded.indices.to_numpy()
        return np.clip(raw, 0, 1)[at], found[at], cosine[at]


def unit(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(owner, weight * weight, n))
    return weight / np.maximum(norm, 1e-300)[owner]


def isotonic(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Points of the rising curve closest to the labels (pool adjacent violators), smoothed by one
    pseudo-label on each side of a pool."""
    pools: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b2 = pools.pop()
            pools[-1] = [pools[-1][0] + b2[0], pools[-1][1] + b2[1], pools[-1][2], b2[3]]
    return [((lo + hi) / 2, (s + 0.5) / (n + 1)) for s, n, lo, hi in pools]


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5))


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold): at most EXAMPLES labelled rows, smallest hash of the id first.

    The bound holds before any text moves: ids are chosen first and then broadcast.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.where(fold(F.col("doc_id")) != 0).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    chosen = materialize(chosen.withColumn("fold", fold(F.col("doc_id"))), "toxicity-labels")
    return materialize(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-examples")


def _document_frequencies(docs: DataFrame, vocabulary: pa.Array) -> tuple[np.ndarray, int]:
    """In how many of all ``docs`` each term of the vocabulary is, and how many there are."""

    def run(batches):
        numbers = dict(zip(vocabulary.to_numpy(zero_copy_only=False).tolist(), range(len(vocabulary)), strict=True))
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for _, texts in slices(b.column(0)):
                _, term, _, words = term_counts(texts)
                known = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
                seen = np.bincount(term, minlength=len(words))
                df[known[known >= 0]] += seen[known >= 0]
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used], pa.int64())], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def relevance(with_1: np.ndarray, with_any: np.ndarray, share: float) -> np.ndarray:
    """Weight of each term for the label: FLOOR, and more the further label 1 is over its share.

    ``with_1`` of the ``with_any`` examples that have a term have label 1. The count has a continuity
    correction of a half, so that no term of a single example rises over FLOOR.
    """
    z = (with_1 - 0.5 - with_any * share) / np.sqrt(np.maximum(with_any * share * (1 - share), 1e-12))
    return FLOOR + np.maximum(z - EVIDENCE, 0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most EXAMPLES labelled rows; document frequencies come from all of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. Folds 1 to 3 are the indexed examples,
    fold 4 calibrates. The vocabulary is every term of the indexed examples. A term weighs
    (1 + log count) times its inverse document frequency log((1 + documents) / (1 + documents with it))
    times its ``relevance``, so that chance likeness in common words doesn't outvote telling ones.
    Without labelled rows, or with one label only, every score is the prior share of label 1 (0 without rows).
    """
    sample = _examples(docs, labels)

    def bags(batches):
        for b in batches:
            text, term, count, words = term_counts(b.column("text"))
            names = pa.array(words, pa.string()).take(pa.array(term))
            cuts = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)), pa.int32())
            cols = [*(b.column(k) for k in ("doc_id", "toxic", "fold")), pa.ListArray.from_arrays(cuts, names), pa.ListArray.from_arrays(cuts, pa.array(count, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "fold", "term", "n"])

    got = sample.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"), "text")
    got = got.mapInArrow(bags, "doc_id bigint, toxic int, fold int, term array<string>, n array<bigint>").toArrow().combine_chunks()
    y, in_fold = got.column("toxic").to_numpy(), got.column("fold").to_numpy()
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    # the calibration fold is indexed too when the other folds have one label only
    apart = len(set(y[in_fold != 4])) == 2
    chosen = np.flatnonzero(in_fold != 4) if apart else np.arange(len(y))
    nothing = Model(pa.array([], pa.string()), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), BlockMaxIndex(*[np.zeros(0, np.int64)] * 3, 0), prior)
    if len(set(y[chosen])) < 2:
        return nothing

    def entries(rows: np.ndarray):
        part = got.take(pa.array(rows))
        term, n = (part.column(k).combine_chunks() for k in ("term", "n"))
        owner = np.repeat(np.arange(len(rows)), pc.list_value_length(term).to_numpy())
        return owner, term.flatten(), n.flatten().to_numpy()

    owner, names, count = entries(chosen)
    coded = names.dictionary_encode()
    vocabulary, term = coded.dictionary, coded.indices.to_numpy()
    df, n_docs = _document_frequencies(docs, vocabulary)
    idf = np.maximum(np.log((1 + n_docs) / (1 + df)), 1e-6)
    label = y[chosen].astype(float)
    weight = idf * relevance(np.bincount(term, label[owner], len(idf)), np.bincount(term, minlength=len(idf)), label.mean())
    raw = unit(owner, (1 + np.log(count)) * weight[term], len(chosen))
    # like examples side by side: by heaviest term, then id
    order = np.lexsort((term, -raw, owner))
    first = order[np.searchsorted(owner[order], np.arange(len(chosen))).clip(max=max(len(order) - 1, 0))]
    ids = got.column("doc_id").to_numpy()[chosen]
    rank = np.lexsort((ids, term[first], -weight[term[first]]))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    model = Model(vocabulary, weight, ids[rank], label[rank], BlockMaxIndex(place[owner], term, raw, len(rank)), prior)
    held = np.flatnonzero(in_fold == 4)
    if apart and len(held) >= 30:
        owner, names, count = entries(held)
        at = pc.index_in(names, vocabulary).to_numpy(zero_copy_only=False)
        known = ~np.isnan(at.astype(float))
        owner, term, count = owner[known], at[known].astype(np.int64), count[known]
        found, cosine = model.index.search(owner, term, unit(owner, (1 + np.log(count)) * weight[term], len(held)), len(held), NEIGHBOURS)
        some = found[:, 0] >= 0
        model.curve = isotonic(model.vote(found, cosine)[some], y[held][some].astype(float))
    return model


def score_texts(df: DataFrame, model: Model, text_col: str = "text", evidence: bool = True) -> DataFrame:
    """``(row, score, evidence)``: score from 0 to 1 of each whole text; row holds all its columns.

    evidence lists the voting examples as (doc_id, label, similarity), best first: every text that
    shares a term with an example has some. Null and empty texts, and texts without any of the
    examples' terms, get the prior share of label 1 and no evidence. Repeated rows score alike; an
    empty table gives no rows. Labels and other columns never enter a score.
    """
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text_col].alias("text"))

    def run(batches):
        numbers = model.numbers()
        for b in batches:
            for at, texts in slices(b.column("text")):
                scores, found, cosine = model.score(texts, numbers)
                some = found >= 0 if evidence else np.zeros(found.shape, bool)
                cuts = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]), pa.int32())
                each = [pa.array(model.ids[found[some]], pa.int64()), pa.array(model.labels[found[some]].astype(int), pa.int32()), pa.array(cosine[some], pa.float64())]
                why = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(each, ["doc_id", "label", "similarity"]))
                yield pa.RecordBatch.from_arrays([b.column("row").slice(at, len(texts)), pa.array(scores, pa.float64()), why], ["row", "score", "evidence"])

    schema = packed.select("row", F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<doc_id:bigint,label:int,similarity:double>>").alias("evidence")).schema
    return packed.mapInArrow(run, schema)


def labelled_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    model = fit(named, labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].alias("toxic")))
    pa.default_memory_pool().release_unused()  # else the pool keeps the examples' freed buffers for as long as the driver lives
    return model


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns."""
    scored = score_texts(docs, labelled_model(docs, labels), evidence=False)
    return scored.where(F.col("score") < threshold).select("row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, labelled_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence"
    )
