"""Language identification: held-out accuracy, backoff and edge cases."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from glosswork.llm import langid
from glosswork.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs)
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs if got[r.doc_id].held_out and r.lang]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_scores(words, training):
    """Mean frequency scores by the definition, over the whole vocabulary."""
    counts, grams = {}, {}
    for lang, text in training:
        for w, n in langid.words_of(text).items():
            counts.setdefault(lang, {})[w] = counts.get(lang, {}).get(w, 0) + n
    for lang, known in counts.items():
        for w in known:
            for k in langid.ORDERS:
                for g in langid.grams_of(w, k):
                    grams.setdefault((lang, k), {})[g] = grams.get((lang, k), {}).get(g, 0) + 1

    def freq(table, x):
        return min(langid.PENALTY, -math.log10(table[x] / sum(table.values()))) if x in table else langid.PENALTY

    out = {}
    for lang in counts:
        total = 0.0
        for w in [w for w, n in words.items() for _ in range(n)]:
            if any(w in c for c in counts.values()):
                total += freq(counts[lang], w)
                continue
            for k in langid.ORDERS:
                known = [g for g in langid.grams_of(w, k) if any(g in grams.get((x, k), {}) for x in counts)]
                if known:
                    total += sum(freq(grams.get((lang, k), {}), g) for g in known) / len(known)
                    break
            else:
                total += langid.PENALTY
        out[lang] = total
    return out


TRAINING = [("en", "the cat and the dog"), ("en", "the bird sang"), ("de", "der hund und die katze"), ("fr", "le chat et le chien"), ("fr", "été à côté")]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(TRAINING)], "lang string, text string, doc_id long").repartition(3)
    return langid.train(rows, F.col("lang"), F.col("text"))


@pytest.mark.parametrize("unseen", [1, 3, 1000])
def test_scores_by_definition(model, monkeypatch, unseen):
    monkeypatch.setattr(langid, "UNSEEN", unseen)
    assert model.languages == ["en", "fr", "de"]
    for text in ["the hund", "katzen und vögel", "chienne", "qqq", "dogs sang der été", "zzz the zzz", "a é b the catdog hunde Katz 漢 漢字"]:
        expected = plain_scores(langid.words_of(text), TRAINING)
        total = model.scores([{}, langid.words_of(text)])[1]
        assert {x: pytest.approx(expected[x], rel=1e-5) for x in model.languages} == dict(zip(model.languages, total, strict=True))
        (lang, score), none = model.predict([text, None])
        assert none == ("und", 0.0)
        assert lang == min(model.languages, key=lambda x: round(expected[x], 5)) and 0 < score <= 1


def test_edges(spark, tmp_path):
    """Nulls, texts without letters, long texts, repeated rows, unseen scripts, clashing extra columns."""
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, *TRAINING[k % 5]) for k, i in enumerate(learned[:40])]
    rows += [
        (None, "xx", "never learned"), (1_000, "en", None), (1_001, None, ""), (1_002, None, "12 ½ ² !?"), (1_003, None, "katze " * 200_000),
        (1_004, None, "the dog"), (1_004, None, "the dog"), (1_005, None, "漢字"), (1_006, "de", "   "),
    ]
    table = spark.createDataFrame([(*r, "s", 1.0, "lang") for r in rows], "doc_id long, lang string, text string, source string, score double, lang_pred string")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["op13_language_id"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert not got[None][0].held_out and got[None][0].lang_pred in ("en", "fr", "de")
    assert [got[i][0].lang_pred for i in (1_000, 1_001, 1_002, 1_006)] == ["und"] * 4 and got[1_002][0].score == 0
    assert got[1_003][0].lang_pred == "de" and [r.lang_pred for r in got[1_004]] == ["en", "en"]
    assert got[1_005][0].lang_pred == "en"  # no evidence: the language with the most training words


def test_nothing_learned(spark, tmp_path):
    schema = "doc_id long, lang string, text string"
    spark.createDataFrame([(1, None, "words"), (2, None, None)], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert {r.lang_pred for r in QUERIES["op13_language_id"](spark, f"{tmp_path}/a").collect()} == {"und"}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert QUERIES["op13_language_id"](spark, f"{tmp_path}/b").count() == 0


def test_vocabulary_bound(spark):
    """Of each language the most frequent rows stay; ties beyond the bound go together."""
    rows = [("a", f"w{i}", 1 + i // 3) for i in range(30)] + [("b", "x", 5), ("b", "y", 5), ("c", "z", 1)]
    counts = spark.createDataFrame(rows, "lang string, item string, n long")
    kept = langid.most_frequent(counts, ["lang"], 7).collect()
    assert sorted(r.item for r in kept if r.lang == "a") == sorted(f"w{i}" for i in range(24, 30))
    assert {r.item for r in kept if r.lang != "a"} == {"x", "y", "z"}


def test_words_are_runs_of_letters():
    """Counting tokens first gives the same words as a search for runs of letters."""
    for text in ["Ab ab, a-b x1y été's\u00a0İx ½ 漢字" + "z" * 70, "", "1 2 _ a_b", "\x1fa\x85b"]:
        expected = {}
        for w in langid._WORD.findall(text.lower()):
            expected[w] = expected.get(w, 0) + 1
        assert langid.words_of(text) == expected
