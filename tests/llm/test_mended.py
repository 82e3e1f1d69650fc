"""Cases that earlier forms of the operators got wrong, against plain computations."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosswork.llm import common, hostrules, learning, neardup, packing, pii, secrets

# ---------------------------------------------------------------- personal data


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.detect(docs).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()
    return [r.s for r in sorted(got, key=lambda r: r.doc_id)]


# Enough labelled contexts for the classifier to be sure of national forms.
TEACHING = [f"call {200 + i}-555-{1000 + i} phone" for i in range(60)] + [f"visa card 4111 1111 1111 1111 {'pay ' * (i % 3)}" for i in range(60)]


def test_neighbouring_numbers_are_one_span_each(spark):
    one, two = "call 212-555-0147 212-555-0148 212-555-0149 phone", "card 4111 1111 1111 1111 212-555-0147"
    got = spans(spark, [one, two, *TEACHING])
    assert got[0] == "phone:5:17,phone:18:30,phone:31:43"
    found = [s.split(":") for s in got[1].split(",")]
    assert ["card", "5", "24"] in found and all(int(a[2]) <= int(b[1]) for a, b in zip(found, found[1:], strict=False))


def test_added_spans_never_overlap(spark):
    rng = random.Random(5)
    pieces = ["212-555-0147", "4111 1111 1111 1111", "+1 (743) 555-3824", "10.0.0.1", "12", "2024-01-02", "a@b.org", "card", "phone", "call", "-", "(", "x"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate([*texts, *TEACHING])), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        base = {tuple(s) for s in r.base}
        added = sorted(tuple(s) for s in r.spans if tuple(s) not in base)
        assert base <= {tuple(s) for s in r.spans}
        assert all(a[2] <= b[0] for a, b in zip(added, added[1:], strict=False))
        assert not any(b[0] < a[2] and a[0] < b[2] for a in added for b in base)


def test_dense_texts_take_linear_time(spark):
    line = "call 212-555-0147 or 212-555-0148, card 4111 1111 1111 1111, ip 10.0.0.1 end\n"
    seconds = []
    for n in (500, 2_000):
        docs = spark.createDataFrame([(0, line * n)], "doc_id long, text string")
        start = time.time()
        text = pii.redact(docs).first().text
        seconds.append(time.time() - start)
        assert text.count("[IP]") == n and "10.0.0.1" not in text
    assert seconds[1] < 8 * max(seconds[0], 1.0)


def test_redaction_against_plain_replacement(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abé漢 \n") for _ in range(rng.randint(1, 900)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 4)))
        rows.append((i, text, [(a, rng.randrange(4), b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:long,kind:int,end:long>>")
    got = {r.doc_id: r.t for r in docs.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, marks in rows:
        out, at = "", 0
        for a, kind, b in marks:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, b)
        assert got[i] == out + text[at:] if marks else text


# ---------------------------------------------------------------- near-duplicates

A, B = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
REPEATED = [(1, A), (1, B), (2, B), (3, A), (4, B + " x")]


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False)]


def test_pipeline_keeps_one_of_each_group(spark):
    more = [(5, "c " + A), (5, A + " z"), (6, "other words here"), (6, "other words here"), (7, None), (None, A), (None, A)]
    docs = spark.createDataFrame([(*r, "s") for r in REPEATED + more], "doc_id long, text string, source string")
    rest = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert rest.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in rest.collect()), key=str)
    assert got == sorted([(1, A), (1, B), (6, "other words here"), (7, None), (None, A), (None, A)], key=str)


def test_recall_against_all_pairs(spark, sf_dir):
    """Every link between different texts of a larger table is found."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(neardup.shingle_set((r.text or "").encode()).tolist()) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, links = {}, 0
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common_counts = {}
    for members in holders.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                common_counts[a, b] = common_counts.get((a, b), 0) + 1
    for (a, b), n in common_counts.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            links += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert links > 20 and got == {i: root(i) for i in sets}


# ---------------------------------------------------------------- secrets


def secret_findings(rng, n):
    """Texts with one planted value each, and whether it is a secret: no single feature decides."""
    rows = []
    for i in range(n):
        real = i % 2 == 0
        value = "".join(rng.choice("0123456789abcdef" if rng.random() < 0.5 else "abcdefghjkmnpqrstuvwxyz0123456789ABCDEFGH") for _ in range(rng.choice([20, 32, 40])))
        value = "a1" + value
        if real:
            before = rng.choice(['token = "', "secret: ", "curl -H auth ", "login with ", "key is "])
        else:
            before = rng.choice(["commit ", "checksum ", 'sha1 = "', "digest of the token test ", "see image "])
            value = value.lower() if rng.random() < 0.7 else value
        rows.append((i, f"some plain text {before}{value} and more", len("some plain text " + before), real))
    return rows


def test_forest_removes_false_findings(spark):
    """Trained on labelled findings, judged on others: precision and recall on held-out texts."""
    rows = secret_findings(random.Random(9), 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    truth = spark.createDataFrame([(i, at, float(y)) for i, _, at, y in rows], "doc_id long, at long, label double")
    half = truth.where("doc_id < 600")
    found = secrets.findings(docs.where("doc_id < 600")).join(half, "doc_id").where("abs(start - at) <= 1").drop("at")
    got = {(r.doc_id, r.start): r.secret for r in secrets.scan(docs.where("doc_id >= 600"), labels=found).collect()}
    judged = [(y, any(got.get((i, at + d), False) for d in (0, 1))) for i, _, at, y in rows if i >= 600]
    right = sum(y and p for y, p in judged)
    assert right >= 0.9 * sum(y for y, _ in judged) and right >= 0.9 * sum(p for _, p in judged)


def test_candidates_have_a_shape(spark):
    text = "Plain words and 2024 numbers 555 well known, x1 aB a-b a/b c_d é9 ABC token=word"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.value for r in secrets.findings(docs).collect()} == {"x1", "aB", "a-b", "a/b", "c_d", "word"}


# ---------------------------------------------------------------- packing, hosts, samples, numbers


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(Tokenizer.from_file(path))
    rng = random.Random(1)
    letters = ["İ", "क़", "ड़", "ढ़", "क़", "é", "é", "ß", "Σ", "a", "B", "9", ".", ",", "'", "-", "́", "ﬁ", "가", "가", " ", "<|"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        expected = np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.of(text.encode()) == expected, ascii(text)


def test_equal_hosts_have_the_heaviest_prior(spark):
    hosts = spark.createDataFrame([(f"h{i}", 100, 10) for i in range(50)] + [("small", 3, 2)], "host string, n long, fails long")
    alpha, beta = hostrules.beta_prior(hosts.where("host <> 'small'"))
    assert alpha + beta == pytest.approx(5_000) and alpha / (alpha + beta) == pytest.approx(0.1)
    rows = [(h.host, i < h.fails) for h in hosts.collect() for i in range(h.n)]
    light = spark.createDataFrame(rows, "host string, base_failed boolean")
    got = {r.host: r for r in hostrules.host_verdicts(light).collect()}
    assert not any(r.host_failed for r in got.values())


def test_host_verdicts_against_plain_computation(spark):
    rng = random.Random(2)
    hosts = [(f"h{i}", n := rng.randint(1, 80), sum(rng.random() < (0.9 if i % 9 == 0 else 0.1) for _ in range(n))) for i in range(60)]
    light = spark.createDataFrame([(h, i < f) for h, n, f in hosts for i in range(n)], "host string, base_failed boolean")
    n = np.array([x[1] for x in hosts], float)
    f = np.array([x[2] for x in hosts], float)
    mean = f.sum() / n.sum()
    noise = mean * (1 - mean)
    between = ((n * (f / n - mean) ** 2).sum() - (len(n) - 1) * noise) / (n.sum() - (n**2).sum() / n.sum())
    weight = noise / between - 1
    assert 1 < weight < n.sum()
    expected = {h: (k + mean * weight) / (m + weight) for h, m, k in hosts}
    got = {r.host: r for r in hostrules.host_verdicts(light).collect()}
    assert {h: r.rate for h, r in got.items()} == pytest.approx(expected)
    assert all(r.host_failed == (expected[h] > 0.5) for h, r in got.items()) and any(r.host_failed for r in got.values())


def test_sample_is_bounded_before_texts_move(spark):
    rows = [(i, "ab " * (10 + i % 5) if i else "x " * 2_000_000) for i in range(100)] + [(7, "second text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, y int")
    got = learning.fitted(docs, labels, "y", F.lit(True), lambda texts, y, w: (len(texts), sum(map(len, texts)), "second text" in texts), 60, 2_000)
    assert got[0] <= 100 and got[1] <= 2_000 and got[2]


def test_numbers_of_equal_rows(spark):
    rows = spark.createDataFrame([(5,)] * 3_000 + [(i,) for i in range(10)], "k int").repartition(4)
    ranged = common.numbered(rows, F.col("k"))
    got = sorted((r.row_number, r.k) for r in ranged.collect())
    assert [n for n, _ in got] == list(range(3_010)) and [k for _, k in got] == sorted(k for _, k in got)


def test_certificates_and_exchange(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.choice([34, 35, 50, 21, 100, 67])) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    placed = packing.pack(pieces, capacity=100, part_pieces=100)
    bins, ends = {}, {}
    for r in placed.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 100
    certified = packing.certificates(placed, 100).collect()
    assert sum(r.bins for r in certified) + sum(n == 100 for _, _, n in rows) == len(bins)
    for r in certified:
        own = [n for s, m in bins.items() if s >= 0 and s >> 40 == r.part for _, n in m]
        assert r.bound == packing.bins_needed(np.array(own), 100) <= r.bins and r.certified == (r.bins == r.bound)
    once = packing.pack(pieces, capacity=100, part_pieces=100, rounds=0)
    assert len(bins) <= once.select("sequence_id").distinct().count()


def test_ids_travel_apart_from_the_packing(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 50)) for i in range(80)], "doc_id long, text string")
    rows = packing.best_fit_packing(docs, capacity=64, with_ids=True).collect()
    plain = packing.best_fit_packing(docs, capacity=64)
    assert all(len(r.ids) == r.length for r in rows)
    assert sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows) == sorted(
        tuple(r) for r in plain.select("doc_id", "piece", "sequence_id", "offset").collect()
    )
