"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm.test_brute import base, figures, links

import corpus_pipeline
from glosswork.llm import common, hostrules, learning, mixing, neardup, packing, pii, quality, secrets, sharding, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size long"
LONG = "word " * 40_000 + "a" * 60_000 + " 1" * 30_000 + "9" * 50_000 + " x@y" + ".z" * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away today.", "en", "a", 1, None, None, None),
    (2, "The quick brown fox jumps over the lazy dog and runs far away today.", "en", "a", 1, True, 0.0, 3),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None, None),
    (5, " \n\t ", "en", "b", 4, None, None, None),
    (None, "a row without an id, and mail to me@example.com or +1 (523) 555-1055.", "en", None, 3, None, None, None),
    (6, LONG, "en", "c", len(LONG), None, None, None),
    (7, "😀 4111 1111 1111 1111 é x.y@b.c.@d.e 1.2.3.4.5.6.7.8 300.1.1.1", "en", "c", 9, None, None, None),
    (7, "😀 4111 1111 1111 1111 é x.y@b.c.@d.e 1.2.3.4.5.6.7.8 300.1.1.1", "en", "c", 9, None, None, None),
    (8, "<|endoftext|> Ünïcode's \x0c\x85 x\x1cy ΣΑΣ. don't <|STARTOFTEXT|>", "el", "c", 9, None, None, None),
    (9, "one", "en", "a", 3, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in (1, 2, 4, 6, 7, 9)] + [(None, 1, 1), (3, None, None), (8, 7, 7), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    assert packing.best_fit_packing(empty).count() == 0
    rows = packing.best_fit_packing(odd, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for doc_id in (3, 4, 5, 6, 8):
        text = next(r[1] for r in ROWS if r[0] == doc_id) or ""
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [i for p in pieces for i in p.ids] == ids, doc_id
    assert sum(r.doc_id == 7 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]


def test_bounds_and_exchange(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 31, rng.integers(1, 40))
        used = packing.best_fit_decreasing(sizes, 30)[2]
        assert packing.bins_needed(sizes, 30) <= used
    assert packing.bins_needed(np.array([16] * 5), 30) == 5
    sizes = [(i, 0, 0, n, 0) for i, n in enumerate([11, 10, 9, 14, 8, 8, 17, 13, 15, 15, 12, 6, 6, 6] * 40)]
    pieces = spark.createDataFrame(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, 30, part_pieces=70).collect()
    assert len(packed) == len(sizes)
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 30 and len(fill) <= 1.1 * packing.bins_needed(np.array([s[3] for s in sizes]), 30) + 8


def test_mixing(odd, empty):
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id: r["size"] for r in rows}[3] == 0
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 10), (None, 500)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got["a"] == 30 and got["c"] == 30 and abs(sum(got.values()) - 1520) < 1e-9
    assert abs(got["b"] / got[None] - 2 / 5) < 1e-9


def test_sharding(odd, empty):
    assert sharding.shard_documents(empty, 40).count() == 0
    rows = sharding.shard_documents(odd, 4).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(ROWS)
    assert next(r for r in rows if r.doc_id == 3)["size"] == 16
    for n in (1, 2, 3, 5, 17, 40, 41):
        spark = odd.sparkSession
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 9)).collect()]
        assert sorted(got) == list(range(n))


def test_host_rules(odd, empty, spark):
    assert hostrules.host_rules(empty, F.col("source")).count() == 0
    rows = hostrules.host_rules(odd, F.col("source")).collect()
    texts = [(r[0], r[1]) for r in ROWS]
    for r in rows:
        expected = [figures(t) for d, t in texts if d == r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in expected
    good = " ".join(f"w{i}" for i in range(30))
    many = [(i, "bad" if i < 200 and i % 2 else "short", "h1") for i in range(200)]
    many += [(1000 + i, good, "h2") for i in range(300)] + [(2000, good, "h1"), (2001, good, None)]
    kept = {r.doc_id: r.kept for r in hostrules.host_rules(spark.createDataFrame(many, "doc_id long, text string, source string"), F.col("source")).collect()}
    assert not kept[2000] and kept[2001] and all(kept[1000 + i] for i in range(300))


def test_pii(odd, empty):
    assert pii.detect(empty).count() == 0
    rows = pii.detect(odd).select("doc_id", pii.span_text(F.col("base")).alias("base")).collect()
    for doc_id, text, *_ in ROWS:
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base(text or ""))
        assert joined in {r.base for r in rows if r.doc_id == doc_id}
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[None] == "a row without an id, and mail to [EMAIL] or [PHONE]." and texts[3] is None
    assert texts[1] == ROWS[0][1]


def test_pii_finds_hidden_forms(spark):
    rows = [(i, f"please call me at phone (523) 555-10{i:02d} today") for i in range(60)]
    rows += [(100 + i, f"mail ab{i} (at) host{i} (dot) com now") for i in range(60)]
    rows += [(200 + i, f"phone +1 (523) 555-10{i:02d}, mail ab{i}@host{i}.com") for i in range(60)]
    rows += [(300 + i, f"order number 1234567{i:02d} of the year, date 2024-01-{i % 28 + 1:02d}") for i in range(60)]
    found = {r.doc_id: r.s for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert sum(found[i].startswith("phone:") for i in range(60)) > 50
    assert sum(found[100 + i].startswith("email:") for i in range(60)) > 50
    assert all(found[300 + i] == "" for i in range(60))


def test_pii_cuts_runs_of_numbers(spark):
    rows = [
        (1, "212-555-0147 212-555-0148 212-555-0149"), (2, "4111 1111 1111 1111 212-555-0147"),
        (3, "(212) 555-0147 (212) 555-0148"), (4, "212-555-0147"), (5, " ".join(f"212-555-01{i:02d}" for i in range(100))),
    ]
    texts = dict(rows)
    found = {i: set() for i in texts}
    for r in pii.annotated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for c in r["__candidates"]:
            found[r.doc_id].add(texts[r.doc_id][c["start"] : c["end"]])
    assert {"212-555-0147", "212-555-0148", "212-555-0149"} <= found[1]
    assert {"4111 1111 1111 1111", "212-555-0147"} <= found[2]
    assert {"(212) 555-0147", "(212) 555-0148"} <= found[3] and found[4] == {"212-555-0147"}
    assert {f"212-555-01{i:02d}" for i in range(100)} <= found[5]


def test_pii_features_are_bounded(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(str(rng.integers(10)) + "-./ "[rng.integers(4)] for _ in range(9)) + "1 xx" for _ in range(20)) for _ in range(100)]
    found = pii.annotated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = pii.fit(pii._votes(found))
    assert sum(f.startswith("shape=") for f in model.terms) <= 256
    assert sum(f.startswith("marks=") for f in model.terms) <= 64


def test_near_duplicates(odd, empty):
    assert neardup.near_duplicates(empty).count() == 0
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    expected = links({r[0]: r[1] for r in ROWS if r[0] is not None})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == expected
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_near_duplicate_groups(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    for _ in range(12):
        text = [words[i] for i in rng.integers(0, 3000, 100)]
        for _ in range(30):
            other = list(text)
            for j in rng.integers(0, 100, rng.integers(0, 14)):
                other[j] = words[rng.integers(0, 3000)]
            texts[n], n = " ".join(other), n + 1
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == links(texts)


def test_estimate(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], []
    for k in range(60):
        common, own = rng.integers(0, 2**63, 600, np.uint64), rng.integers(0, 2**63, 2 * k * 5, np.uint64)
        a, b = np.unique(neardup._mix(np.r_[common, own[::2]])), np.unique(neardup._mix(np.r_[common, own[1::2]]))
        rows.append((neardup.registers(a).view(np.int64).tolist(), neardup.registers(b).view(np.int64).tolist()))
        truth.append(600 / (600 + len(own)))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(neardup.estimated(F.col("a"), F.col("b"))["jaccard"]).collect()
    assert abs(np.array([r[0] for r in got]) - truth).mean() < 0.05


def test_classifiers(odd, empty, labels):
    for module, train in ((toxicity, toxicity.document_toxicity), (quality, quality.document_quality)):
        assert train(empty, labels).count() == 0 and module.__doc__
        rows = train(odd, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert all(r.held_out is not None for r in rows)
    assert {r.doc_id: r.score for r in toxicity.document_toxicity(odd, labels).collect()}[4] == 0
    assert toxicity.drop_toxic(odd, toxicity.train(odd, labels)).columns == odd.columns


def test_long_texts_leave_the_others_in_the_sample(spark):
    rows = [(i, "x" * (1000 if i % 2 else 5) if i < 8 else f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows + [(9, "text 9")] * 3, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    fit = learning.fitted(docs, marks, "toxic", F.lit(True), lambda texts, y, w: (sorted(texts), y.tolist()), max_chars=600)
    assert fit[0] == sorted(t for _, t in rows if len(t) < 1000) and set(fit[1]) == {0, 1}


def test_toxic_sentences_are_found():
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    texts, y = [], []
    for i in range(300):
        parts = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if i % 4 == 0:
            parts[i % 5] += " villain"
        texts.append(". ".join(parts) + ".")
        y.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(y), np.ones(300))
    of = toxicity._documents(model)
    for text, label in zip(texts, y, strict=True):
        score, found = of(text)
        assert (score >= 0.5) == bool(label)
        assert all("villain" in text[s["start"] : s["end"]] for s in found)


def test_secrets(odd, empty):
    assert secrets.scan(empty).count() == 0
    assert secrets.scan(odd).where("secret").count() == 0


def test_secrets_of_every_form(spark):
    key, block = "Ab3/" * 400, "-----BEGIN RSA PRIVATE KEY-----\nMIIEow\nIBAA\n-----END RSA PRIVATE KEY-----"
    values = {1: key, 2: "p@ss!w0rd#2024", 3: "correcthorsebatterystaple", 4: "hunter2x", 5: block, 6: 'a b\\"c9!', 7: "x9=y8==z7"}
    before = {1: "see ", 2: "password: ", 3: 'token = "', 4: "passwd=", 5: "x ", 6: 'secret => "', 7: "api_key: '"}
    after = {3: '"', 6: '"', 7: "'"}
    pad = "é" * 300 + " "
    rows = [(i, pad + before[i] + v + after.get(i, "") + " then") for i, v in values.items()]
    rows += [(100 + i, f'password = "{i * 7919:x}k!{i * 104729:x}" and {"some plain words " * 20} commit {i * 15485863:x}') for i in range(40)]
    rows += [(200 + i, f'secret: "{w * 3}" in words') for i, w in enumerate(["zorble", "quaxon", "mifrey", "plonkt"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {i: set() for i in texts}
    for r in secrets.findings(docs).collect():
        assert texts[r.doc_id][r.start : r.end] == r.value
        found[r.doc_id].add(r.value)
    assert all(v in found[i] for i, v in values.items())
    got = secrets.scan(docs).collect()
    assert len(got) == len({(r.doc_id, r.start, r.end) for r in got})
    secret = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in got if r.secret}
    assert all((i, values[i]) in secret for i in (2, 3, 5))
    assert not {"some", "plain", "words", "and", "in"} & {v for _, v in secret}


def test_topk(spark):
    vectors = [
        (0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
        (None, [9.0, 9.0]), (5, [1.0, 2.0]), (6, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [-1.0]),
    ]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int")
    rows = topk.top_inner_products(df, F.col("vec_id") % 50 == 0).collect()
    got = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 0]
    one = 256 * 256 + 512 * 512
    assert got[:2] == [(1, one), (5, one)] and [i for i, _ in got[2:4]] == [6, 6] and len(got) == 5
    assert topk.top_inner_products(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert [r.vec_id for r in topk.top_inner_products(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()] == [1]


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)) * rng.lognormal(size=(700, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") % 9 == 0).collect()}
    for i in range(0, 700, 9):
        s = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, s[j]) for j in order]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (60, 70), (5, 5)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((50, 60, 70, 100), 50)}


def test_stages(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns, name
    once = corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in once) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = common.settled(stage(spark, left, sf_dir))
    model = toxicity.train(docs, labels)
    of = toxicity._documents(model)
    clean = {r.doc_id: r.text for r in docs.collect() if of(r.text)[0] < 0.5}
    groups = links(clean, size=5)
    assert {r.doc_id for r in left.collect()} == {d for d, (_, c) in groups.items() if c == d}
    assert all(not base(r.text) for r in left.collect())
    packed = corpus_pipeline.run(spark, sf_dir)
    copies = {r.doc_id: r["count"] for r in mixing.mixed_documents(left).groupBy("doc_id").count().collect()}
    first = {r.doc_id: r["count"] for r in packed.where("piece = 0").groupBy("doc_id").count().collect()}
    assert first == copies
