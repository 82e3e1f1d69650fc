"""Language identification: word frequencies first, then ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.llm.common import prepared, settled

ORDERS = (5, 4, 3, 2, 1)  # characters of the n-grams, longest first
ENTRIES = 400_000  # (language, word) entries of a model, and again (language, n-gram) entries, at most
CELLS = 25_600_000  # scores (entries times languages) of either kind, at most
PENALTY = 7.0  # minus log10 of the frequency that a word or n-gram has in languages that do not hold it
UNSEEN = 20_000  # unseen words that are looked up at once
HELD = 1 << 17  # partial counts that a task holds at once
NO_LANGUAGE = "und"
LONGEST = 32  # letters of a word; longer runs (scripts without spaces) come in pieces
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def split_at_letters(tokens: dict[str, int]) -> dict[str, int]:
    """Runs of letters in counted tokens without white space, counted."""
    words: dict[str, int] = {}
    for token, n in tokens.items():
        if token.isalpha() and len(token) <= LONGEST:
            words[token] = words.get(token, 0) + n
        else:
            for word in _WORD.findall(token):
                words[word] = words.get(word, 0) + n
    return words


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def words_of(text: str | None) -> dict[str, int]:
    """Lower-cased runs of letters of a text, counted."""
    return split_at_letters(Counter(tokens_of(text)))


def has_letter(words: Iterable[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams_of(word: str, order: int) -> list[str]:
    """n-grams of a word with a blank on either side; single characters without."""
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _partial_counts(
    rows: DataFrame, pieces: Callable[[str], list[str]], items: Callable[[dict[str, int]], dict[str, int]], schema: str
) -> DataFrame:
    """lang, item and n: how often `pieces` gives each item of the rows (lang, text), summed in the task before the shuffle.

    `items` maps the counted pieces of a task to the counts that it gives out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def emitted() -> pa.RecordBatch:
            parts = [(lang, item, n) for lang, counter in counts.items() for item, n in items(counter).items()]
            counts.clear()
            kinds = (pa.string(), pa.string(), pa.int64())
            columns = list(zip(*parts, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "item", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(pieces(text))
                if sum(map(len, counts.values())) > HELD:
                    yield emitted()
        yield emitted()

    prepared(rows.sparkSession)
    return rows.mapInArrow(run, schema).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _all_grams(word: str) -> list[str]:
    return [g for order in ORDERS for g in grams_of(word, order)]


def most_frequent(counts: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """The rows of each key whose `n` is at least the smallest count at which no more than `bound` rows are left.

    The counts of counts decide, so that no key's rows meet in one task.
    """
    levels = counts.groupBy(*keys, "n").agg(F.count("*").alias("__rows"))
    down = Window.partitionBy(*keys).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = levels.withColumn("__sum", F.sum("__rows").over(down)).where(F.col("__sum") <= bound).groupBy(*keys).agg(
        F.min("n").alias("__least")
    )
    # One row for each key.
    return counts.join(F.broadcast(least), keys).where("n >= __least").drop("__least")


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit value for each `order` neighbouring code points; different n-grams hardly ever share one."""
    n = max(len(codes) - order + 1, 0)
    value = np.full(n, order, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(order):
            value = (value ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return value


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _table(items: list[str], langs: list[int], values: np.ndarray, languages: int) -> tuple[dict[str, int], np.ndarray]:
    """A row for each item and its scores: the penalty in languages that do not hold it."""
    row = {item: i for i, item in enumerate(dict.fromkeys(items))}
    scores = np.full((len(row), languages), PENALTY, np.float32)
    scores[[row[x] for x in items], langs] = values
    return row, scores


@dataclass
class LanguageModel:
    """`languages` come by falling number of training words, then by name: ties go to the first.

    `words` has the row of each known word in `word_scores`; `grams` has for each order the sorted hashes of the known
    n-grams with their scores. Scores are minus log10 of the frequency in each language.
    """

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(languages: list[str], words: tuple[dict[str, int], np.ndarray], grams: tuple[dict[str, int], np.ndarray]) -> LanguageModel:
        by_order = {}
        for order in ORDERS:
            own = [(gram_hashes(_codes(g), order)[0], i) for g, i in grams[0].items() if len(g) == order]
            keys = np.array([h for h, _ in own], np.uint64)
            at = np.argsort(keys)
            by_order[order] = keys[at], grams[1][np.array([i for _, i in own], np.int64)[at]]
        return LanguageModel(languages, *words, by_order)

    def unseen_scores(self, words: list[str]) -> np.ndarray:
        """For each word the mean over its longest n-grams of which any language knows one, without the unknown ones."""
        out = np.full((len(words), len(self.languages)), PENALTY)
        codes = _codes(f" {' '.join(words)} ")
        blank = codes == 32
        word = np.cumsum(blank) - 1  # a blank belongs to the word behind it
        open_words = np.ones(len(words) + 1, bool)
        open_words[-1] = False
        for order in ORDERS:
            n = len(codes) - order + 1
            if n <= 0 or not open_words.any():
                continue
            # Inside an n-gram no word ends; single characters are letters.
            inside = open_words[word[:n]] & ~(blank[:n] if order == 1 else np.zeros(n, bool))
            for j in range(1, order - 1):
                inside &= ~blank[j : j + n]
            at = np.flatnonzero(inside)
            keys, scores = self.grams[order]
            if not len(keys) or not len(at):
                continue
            hashes = gram_hashes(codes, order)[at]
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[place] == hashes
            owner, place = word[at[hit]], place[hit]
            counts = np.bincount(owner, minlength=len(words) + 1)[: len(words)]
            found = counts > 0
            for k in range(len(self.languages)):
                sums = np.bincount(owner, scores[place, k], len(words) + 1)[: len(words)]
                out[found, k] = sums[found] / counts[found]
            open_words[:-1] &= ~found
        return out

    def scores(self, texts: list[dict[str, int]]) -> np.ndarray:
        """For each text, given as counted words, the sum of its words' scores in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        unseen: list[str] = []
        owners, shares = [], []

        def settle() -> None:
            if unseen:
                np.add.at(total, np.concatenate(owners), np.concatenate(shares)[:, None] * self.unseen_scores(unseen))
            for x in (unseen, owners, shares):
                x.clear()

        for i, counts in enumerate(texts):
            if not counts:
                continue
            rows = np.fromiter(map(self.words.get, counts, repeat(-1)), np.int64, len(counts))
            times = np.fromiter(counts.values(), np.float64, len(counts))
            held = rows >= 0
            total[i] += times[held] @ self.word_scores[rows[held]]
            if not held.all():
                rest = np.flatnonzero(~held)
                words = list(counts)
                for first in range(0, len(rest), UNSEEN):
                    part = rest[first : first + UNSEEN]
                    unseen += [words[at] for at in part.tolist()]
                    owners.append(np.full(len(part), i))
                    shares.append(times[part])
                    if len(unseen) >= UNSEEN:
                        settle()
        settle()
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its posterior under equal priors; `und` and 0 without letters or learned languages."""
        counted = [words_of(x) for x in texts]
        known = [bool(self.languages) and has_letter(words) for words in counted]
        total = self.scores([words if good else {} for words, good in zip(counted, known, strict=True)])
        out = []
        for row, good in zip(total, known, strict=True):
            best = int(row.argmin()) if good else 0
            out.append((self.languages[best], float(1 / np.power(10.0, np.maximum(row[best] - row, -300)).sum())) if good else (NO_LANGUAGE, 0.0))
        return out


def train(rows: DataFrame, lang: Column, text: Column, entries: int = ENTRIES) -> LanguageModel:
    """Word and n-gram frequencies of each language over all rows whose language and text are not null.

    All words of all rows are counted. The model keeps, of each language, the most frequent words
    and n-grams, `entries` of either kind over all languages at most; words left out are unseen ones.
    n-grams are counted once for each distinct word, as unseen words resemble rare ones.
    """
    known = rows.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where("lang is not null and text is not null")
    schema = "lang string, item string, n long"
    words = settled(_partial_counts(known, tokens_of, split_at_letters, schema))
    grams = settled(_partial_counts(words.select("lang", "item"), _all_grams, dict, schema).withColumn("order", F.length("item")))
    # One row for each language, and for each language and order.
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    sums = {(r["lang"], r["order"]): r["n"] for r in grams.groupBy("lang", "order").agg(F.sum("n").alias("n")).collect()}
    share = min(entries, CELLS // max(len(languages), 1)) // max(len(languages), 1)
    place = {x: i for i, x in enumerate(languages)}

    def kept(counts: DataFrame, keys: list[str], bound: int, total) -> tuple[dict[str, int], np.ndarray]:
        # At most `entries` short rows come to the driver.
        table = most_frequent(counts, keys, bound).select("lang", "item", "n").toArrow()
        langs, items, n = (table.column(c).to_pylist() for c in ("lang", "item", "n"))
        whole = np.array([total(x, item) for x, item in zip(langs, items, strict=True)], np.float64)
        values = np.minimum(PENALTY, -np.log10(np.array(n, np.float64) / whole))
        return _table(items, [place[x] for x in langs], values, len(languages))

    return LanguageModel.of(
        languages,
        kept(words, ["lang"], share, lambda x, _: totals[x]),
        kept(grams, ["lang", "order"], share // len(ORDERS), lambda x, item: sums[x, len(item)]),
    )


def identify(docs: DataFrame, text: Column, model: LanguageModel, keys: dict[str, Column]) -> DataFrame:
    """`keys`, lang_pred and score of each row by its whole text.

    Null texts and texts without a letter are `und` with score 0, as is every text where no language
    was learned. Equal scores go to the language with the most training words. Repeated rows count
    each; an empty table gives an empty one; other columns are ignored.
    """
    prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ENTRIES
    names, n = [*keys, "lang_pred", "score"], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            made = held.predict(batch.column(n).to_pylist())
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names)

    light = docs.select(*[c.alias(k) for k, c in keys.items()], text.cast("string").alias("__text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema.fields[:n])
    return light.mapInArrow(run, f"{fields}, lang_pred string, score double")


def document_languages(docs: DataFrame, by: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; lang is learned from those not held out.

    Held out are documents whose checksum of doc_id leaves `rest` modulo `by`; null ids are neither held out nor learned from.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % by
    model = train(docs.where(remainder != rest), F.col("lang"), F.col("text"))
    keys = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(remainder == rest, F.lit(False))}
    return identify(docs, F.col("text"), model, keys)
