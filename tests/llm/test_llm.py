"""Operators of the llm subpackage against brute force on small inputs."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.llm import exact_dedup, huffman, licenses, media, minhash, mixing, packing, pii, queries, toxicity, urls
from geoledger.llm.tokens import TextEncoder, public_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "A b", "a B", "x " * 3000, "é　 z", "a  b\n\nc ", "<|endoftext|> q", "7" * 400]


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id bigint, text string, source string, size bigint")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [*enumerate(ODD), (None, "null id"), (3, "a"), (3, "a")])


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, size bigint")


@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_exact_dedup"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        before = dict(label)
        for k, a in enumerate(ids):
            for b in ids[:k]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_groups(spark, texts):
    rows = [*texts.items(), (900, "a b c d e f g h i j k"), (901, "A b c d e f g h i j k l"), (902, None), (903, "  "), (904, "one"), (905, "ONE")]
    got = minhash.near_groups(frame(spark, rows), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2)


def test_near_groups_many_copies_and_a_chain(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 60 - i % 9], *[f"x{i}_{k}" for k in range(i % 9)]])) for i in range(120)]
    got = minhash.near_groups(frame(spark, rows), shingle=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5)


def test_odd_rows(spark, odd):
    near = minhash.near_groups(odd, shingle=2).collect()
    assert len(near) == odd.count() and all(r.kept for r in near if r.doc_id is None)
    exact = exact_dedup.add_batch(odd, exact_dedup.DigestIndex(spark)).collect()
    assert {r.keep_id for r in exact if r.doc_id in (0, 1, 2)} == {2}  # most code points
    assert exact_dedup.exact_dedup(odd).columns == odd.columns
    assert mixing.mix(odd).where("size = 0 and taken > 0").count() == 0
    assert mixing.emit(mixing.mix(odd)).columns == odd.columns
    assert {r.n_bytes for r in media.store_texts(odd).collect()} >= {0, 1}
    found = licenses.scan_licenses(odd).collect()
    assert len(found) == odd.count() and all(r.n_words == 0 and r.matches == [] for r in found if not (r.row.text or "").strip())
    assert pii.find_pii(odd).count() == odd.count()


def test_empty_tables(spark):
    none = empty(spark)
    assert minhash.near_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert pii.find_pii(none).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_index_keeps_earlier_rows(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.add_batch(frame(spark, [(1, "a b"), (2, "ab")]), index).collect()
    again = exact_dedup.add_batch(frame(spark, [(3, "a  b"), (4, "c")]), index).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in again} == {3: (1, False), 4: (4, True)}


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_encoder_is_the_tokenizer(texts, name, kind):
    e = TextEncoder(public_path(name), kind)
    given = [t or "" for t in [*texts.values(), *ODD, "a\x1cb c", "don't  x", " a b ", "1234 \x01 z"]]
    for got, want in zip(e.encode(given), e.tokenizer.encode_batch(given, add_special_tokens=False), strict=True):
        assert list(got) == want.ids


def test_packing(spark, odd):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]]
        assert sum(r.length for r in s) <= 1024
    lengths = [5, 1024, 1025, 3000, 700, 300, 90, 1, 1, 64]
    pieces = sorted(p for s in packing.pack(lengths) for p in s)
    assert [sum(n for d, _, n in pieces if d == k) for k in range(len(lengths))] == lengths


@pytest.mark.parametrize("most", [1, 3000, 20_000])
def test_encoder_forgets(most):
    e = TextEncoder(public_path("word_bpe_49k.json"), "words", most_bytes=most)
    texts = [" ".join(f"w{k * j % 97} common{k % 5} x{k}" for k in range(40)) for j in range(30)]
    for t in texts:
        assert list(e.encode([t])[0]) == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_huffman_round_trip(spark, odd):
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.zipf(1.3, 5000) % 400, minlength=400)
    lengths = huffman.code_lengths(counts, 9)
    assert lengths.max() <= 9 and sum(2.0 ** -x for x in lengths[lengths > 0].astype(int)) <= 1 + 1e-9
    ids = np.repeat(np.arange(400), counts)
    rng.shuffle(ids)
    raw, marks = huffman.encode_block(ids, huffman.canonical_codes(lengths), lengths)
    (back,) = huffman.decode(raw, marks.copy(), [len(ids)], huffman.decode_table(lengths))
    assert (back == ids).all()
    n = [0, 1, 700, 0, 256, 257, len(ids) - 1214, 0]
    each, at = huffman.encode_documents(ids, n, huffman.canonical_codes(lengths), lengths)
    alone = [huffman.encode_block(x, huffman.canonical_codes(lengths), lengths) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert each == [x for x, _ in alone] and [list(m) for m in at] == [list(m) for _, m in alone]
    path = huffman.scratch_path(spark, "test-huffman")
    huffman.write_ids(odd.where("doc_id is not null"), path)
    e = TextEncoder(public_path("word_bpe_49k.json"), "words")
    for r in huffman.read_ids(spark, path).collect():
        want = [*e.encode([ODD[r.doc_id] or ""])[0], 1]
        assert list(np.frombuffer(r.ids, "<u4")) == want


def test_media_round_trip():
    for n in (0, 1, 64, 65, 64 * 32, 64 * 33, 64 * 100 + 5):
        payload = media.pad(bytes(range(256)) * (n // 256) + bytes(range(n % 256)))
        stored = media.write_media(payload)
        (track,) = media.parse_media(stored)
        assert media.read_payload(stored, track) == payload
        assert track["codec"] == "raw " and track["duration"] == len(payload)
        assert len(track["keyframes"]) == -(-len(track["samples"]) // 16)
    assert media.parse_media(None) == media.parse_media(b"junk" * 9) == media.parse_media(stored[:200]) == []


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = {}
    for kind, pattern in PLAIN:
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def test_base_spans(spark, texts):
    extra = [
        "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12", "9" * 3000,
        "\U0001f600 a@b.cd é 10.0.0.1", "x" * 5000 + "@a.b", "a@b." + "c." * 3000 + "d", "", None, "+49 30 1234567, me@x.org me@x.org",
    ]
    rows = [*texts.items(), *((5000 + k, t) for k, t in enumerate(extra))]
    given = dict(rows)
    for r in pii.base_spans(frame(spark, rows)).collect():
        want = brute_spans(given[r.row.doc_id])
        assert {k: [(s.start, s.end) for s in r[k]] for k in want} == want, given[r.row.doc_id]


def test_op5_names_kinds(spark, tmp_path):
    """The query's counts, digest and span list on odd rows, by the contract's plain patterns."""
    rows = [
        (1, "a@b.c x@y.z 1.2.3.4, 4111 1111 1111 1111, +49 30 1234567"), (2, "9.9.9.9 a@b.c\U0001f600 a@b.c +1-555-0100 +1 (555) 123-4567"), (3, None), (4, ""),
        (5, "4111111111111111\n4111-1111-1111-1111"), (6, "nothing"), (None, "é a@b.c"), (6, "10.0.0.1 10.0.0.256"),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        spans = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        want.append((i, *map(len, spans.values()), hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(map(str, map(tuple, pii.op5_pii(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_op5_names_terms(spark, tmp_path):
    """Spans that the method adds are named term, beside the base ones."""
    rows = [(k, f"{'Zaphod' if k < 5 else 'nobody'} said number {'q' * (k % 7 + 4)} {'to zz@qq.org' if k < 5 else ''} word{'abcdefgh'[k % 8] * 3}") for k in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op5_pii(spark, str(tmp_path)).collect()}
    assert len(got) == 400 and got[1].spans == "email:28:37,term:0:6,term:25:27" and got[200].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(b"email:28:37").hexdigest()


def test_disclosing_terms(spark):
    rows = [(k, f"{'Zaphod' if k < 5 else 'nobody'} said number {'q' * (k % 7 + 4)} {'to zz@qq.org' if k < 5 else ''} word{'abcdefgh'[k % 8] * 3}") for k in range(400)]
    found = {r.row.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert [(s.start, s.end, s.value) for s in found[1].term] == [(0, 6, "Zaphod"), (25, 27, "to")]  # no other text has these words
    assert found[200].term == []
    clean = {r.row.doc_id: r.sanitized for r in pii.sanitize(pii.find_pii(frame(spark, rows))).collect()}
    assert clean[0].startswith(" said number qqqq  [EMAIL] word")


def test_licenses(spark, texts):
    rows = [*texts.items(), (7000, "CC BY cc-by. MIT License\nReleased under the MIT License."), (7001, "see\nLicensed under the Apache License, v 2.0"), (7002, "gnu general public licenses"), (7003, None)]
    given = dict(rows)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        text = given[r.row.doc_id]
        w = split(text)
        places = sorted((label, k) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert r.n_words == len(w) and sorted((p.label, p.start) for p in r.places) == places
        want = set()
        for n, line in enumerate((text or "").split("\n")):
            for label, t in licenses.TEMPLATES.items():
                tokens = set(t.split())
                if len(tokens & set(split(line))) >= licenses.CONTAINMENT * len(tokens) - 1e-9:
                    want.add((n, label))
        assert {(m.block, m.label) for m in r.matches} == want


def test_urls(spark):
    rows = [
        (0, "http://A.example.NET/en/1?x"), (1, "https://b.net/q"), (2, "http://x.example.com/de/5#a"), (3, "http://q.org/fr/2"), (4, None), (5, "no scheme"), (6, "http://net"),
        *[(10 + k, f"http://cheap-pills{k}.example.com/buy/{k}") for k in range(20)], *[(40 + k, f"http://garden{k}.example.com/tips/{k}") for k in range(40)], (99, "http://cheappills.example.com/buy/1"),
    ]
    got = {r.row.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert [got[k].rule for k in range(7)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None]
    assert [got[k].verdict for k in range(4)] == ["allow", "block", "block", "allow"]
    assert (got[0].host, got[0].path, got[4].host, got[5].path, got[6].path) == ("a.example.net", "/en/1", "", "", "")
    assert "cheap" in got[99].words and "pills" in got[99].words and got[99].verdict == "block"
    assert got[41].verdict == "allow"


def test_short_names_disclose(spark):
    """Names of two to three letters, in Latin and CJK, and one of more than forty."""
    names = ["Kim", "Ana", "\u674e\u660e", "Li", "Wolf" + "e" * 50]
    rows = [(k, f"The file of {names[k // 5] if k < 25 else 'nobody'} says {'q' * (k % 7 + 4)} {f'write to z{k // 5}@qq.org' if k < 25 else 'in the end to all'}") for k in range(400)]
    rows += [(500, "again kim was there")]
    found = {r.row.doc_id: {s.value for s in r.term} for r in pii.find_pii(frame(spark, rows)).collect()}
    assert all(names[k // 5] in found[k] for k in range(25)) and found[500] == {"kim"} and found[300] == set()
    assert not {"to", "of", "the", "The"} & set().union(*found.values())


def test_wrapped_licenses(spark):
    """However a license is wrapped, indented, commented or double-spaced, it is found."""
    import textwrap

    rows, want = [], {}
    for k, (label, t) in enumerate(licenses.TEMPLATES.items()):
        for j, (width, lead, end) in enumerate([(72, "", "\n"), (40, " * ", "\n"), (30, "# ", "\n\n"), (500, "", "\n")]):
            body = end.join(lead + x for x in textwrap.wrap(t.capitalize() + ".", width))
            rows.append((10 * k + j, f"Some words before\nand one line more\n\n{body}\n\nOther text after it\n" + "and more lines\n" * 30))
            want[10 * k + j] = label
    rows += [(900, "permission\n" + "other words here\n\n" * 40 + "is hereby granted free of charge\n" + "other words here\n\n" * 40 + "to any person obtaining a copy of this software and associated")]
    got = {r.row.doc_id: r.matches for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for k, label in want.items():
        found = [(m.block, m.containment) for m in got[k] if m.label == label]
        # a line that has enough of the tokens alone counts by itself, with its own share
        assert found == [(3, 1.0)] or len(found) == 1 and found[0][0] >= 3 and found[0][1] >= licenses.CONTAINMENT and label != "bsd", (k, label, got[k])
    assert "mit-grant" not in {m.label for m in got[900]}


@pytest.mark.parametrize("times", [1, 5])
def test_a_frequent_concatenated_host_is_split(spark, times):
    """A third of a table; its name stands in its paths and subdomains, and rows are repeated."""
    kind = F.when(F.col("id") % 3 == 0, "freebets").otherwise(F.concat(F.lit("garden"), F.col("id") % 50))
    url = F.concat(F.lit("http://"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("s"), F.col("id") % 40, F.lit("."))).otherwise(""), kind, F.lit(".example.com/"), kind, F.lit("/"), F.col("id"))
    rows = spark.range(2000 * times).select("id", url.alias("url"))
    pages = rows.union(rows).union(spark.createDataFrame([(-1, "http://myfreebets.example.com/x"), (-2, "http://windows.example.com/my/x")], "id bigint, url string"))
    got = urls.judge_urls(pages)
    assert {(r.bad, r.verdict) for r in got.select((F.col("row.id") % 3 == 0).alias("bad"), "verdict").where("row.id >= 0").distinct().collect()} == {(True, "block"), (False, "allow")}
    words = {r.host.split(".")[0]: r.words for r in got.where("row.id in (3, -1, -2)").collect()}
    assert {"free", "bets"} <= set(words["freebets"]) and {"free", "bets"} <= set(words["myfreebets"]) and "windows" in words["windows"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    kept = corpus_pipeline.materialize(kept, "t")
    assert kept.columns == docs.columns
    one = corpus_pipeline.materialize(corpus_pipeline.exact(spark, kept, SF), "t")
    keys = [hashlib.sha256(re.sub("[ \t-\r]", "", r.text or "").encode()).digest() for r in kept.collect()]
    assert one.count() == len(set(keys)) and one.columns == docs.columns
    near = corpus_pipeline.materialize(corpus_pipeline.near(spark, one, SF), "t")
    want = brute_components([(r.doc_id, r.text) for r in one.collect()], 5)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if i == c}
    mixed = corpus_pipeline.materialize(corpus_pipeline.mixing(spark, near, SF), "t")
    assert mixed.columns == docs.columns
    assert corpus_pipeline.packing(spark, mixed, SF).select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
