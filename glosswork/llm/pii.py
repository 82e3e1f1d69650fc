"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import settled

KINDS = ("email", "ip", "card", "phone")
CLASSES = ("none", *KINDS)

# The fixed forms. Loops are possessive and runs start at their first character, which finds the
# same matches in linear time and without recursion on long texts.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"

# Wider forms that may hold personal data.
NUMBERS = r"(?<![0-9A-Za-z_])[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9])++"
GROUP = r"[(+]{0,2}+[0-9]++(?:[\x20).\-/]|\((?![0-9]))*+"  # one group of digits of such a run, with its marks
AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z]{2,24}+"

CHAIN = 7  # neighbouring digit groups of a phone or card number within a longer run
MOST = 24  # digits of a run that is a candidate itself
CONTEXT = 40  # characters before a span that context labelers read
SURE = 0.9  # probability from which the classifier adds a span
# Fixed word lists of the context labelers and gazetteers.
BEFORE = {
    "email": r"e-?mail|mailto|courriel|correo|postfach",
    "ip": r"\bip\b|ip-?address|server|host",
    "card": r"card|visa|mastercard|amex|carte|karte|tarjeta",
    "phone": r"phone|\btel\b|call|mobile|\bfax\b|telefon|téléphone|teléfono|handy",
}
NOT_PERSONAL = r"order|invoice|isbn|version|price|serial|\bref\b|\bid\b|\bdate\b|numéro|nummer|número"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRY_CODES = r"^\+(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
DOMAINS = r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"


def running(steps: Column) -> Column:
    """Running sums of an array of lengths, in blocks, so that long arrays are not copied over and over."""
    block = 256

    def of(s: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(s) / block).cast("int") - 1)
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(s, b * block + 1, block))

        def place(all_blocks: Column) -> Column:
            sums = F.transform(all_blocks, lambda x: F.reduce(x, F.lit(0).cast("long"), lambda a, v: a + v))

            def within(x: Column, b: Column, totals: Column) -> Column:
                start = F.reduce(F.slice(totals, F.lit(1), b), F.lit(0).cast("long"), lambda a, v: a + v)
                empty = F.array().cast("array<bigint>")
                return F.reduce(
                    x,
                    F.struct(start.alias("s"), empty.alias("a")),
                    lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a")),
                    lambda acc: acc["a"],
                )

            return F.flatten(_let(sums, lambda t: F.transform(all_blocks, lambda x, b: within(x, b, t))))

        return _let(blocks, place)

    return _let(steps, of)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of start, end (code points, end exclusive) and value."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(both: Column) -> Column:
        p, m = both["p"], both["m"]
        steps = F.transform(
            m, lambda _, i: (F.length(F.get(p, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("long")
        )
        return F.zip_with(
            m, running(steps),
            lambda v, s: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")),
        )

    return _let(F.struct(parts.alias("p"), found.alias("m")), place)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the four fixed forms that pass their checks: array of start, kind (place in KINDS), end; sorted."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.filter(matches(text, IP), lambda m: m["value"].rlike(IP_PARTS)),
        "card": F.filter(matches(text, CARD), lambda m: _let(
            _digits(m["value"]), lambda d: F.length(d).between(14, 19) & _luhn(d)
        )),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(
            matches(text, PHONE), lambda m: F.length(_digits(m["value"])).between(10, 15)
        )).otherwise(none),
    }

    def of_kind(i: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"))

    return F.array_sort(F.concat(*[F.transform(found[kind], of_kind(i)) for i, kind in enumerate(KINDS)]))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _vote(kind: str | int, when: Column) -> Column:
    return F.when(when, F.lit(CLASSES.index(kind) + 1 if isinstance(kind, str) else kind)).otherwise(F.lit(0))


def labelers(value: Column, before: Column) -> list[Column]:
    """Votes on a span: 0 abstains, 1 is no personal data, 2 to 5 are the kinds."""
    digits, low = _digits(value), F.lower(before)
    n = F.length(digits)
    number = value.rlike(r"^[(+]?[0-9]")
    form = [  # regex labelers
        _vote("email", value.rlike(r"@|[(\[]at[)\]]")),
        _vote("ip", value.rlike(IP_PARTS)),
        _vote("card", n.between(14, 19) & _luhn(digits)),
        _vote("card", value.rlike(r"^[0-9]{4}([\x20-][0-9]{4}){2,3}([\x20-][0-9]{1,4})?$")),
        _vote("phone", value.rlike(r"^\+") & n.between(10, 15)),
        _vote("phone", value.rlike(r"^(\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        _vote("none", value.rlike(r"^[0-9]+$") & ~(n.between(14, 19) & _luhn(digits))),
        _vote("none", value.rlike(r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})")),
    ]
    gazetteer = [
        _vote("card", n.between(14, 19) & digits.rlike(ISSUERS)),
        _vote("phone", value.rlike(COUNTRY_CODES)),
        _vote("none", value.rlike(r"^\+") & ~value.rlike(COUNTRY_CODES)),
        _vote("email", value.rlike(DOMAINS)),
    ]
    context = [_vote(kind, low.rlike(words)) for kind, words in BEFORE.items()]
    context.append(_vote("none", number & low.rlike(NOT_PERSONAL)))
    return form + gazetteer + context


def features(value: Column, before: Column) -> Column:
    """Discrete features of a span, as 'name=value', for the classifier."""
    digits, low = _digits(value), F.lower(before)
    marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), ""))), "")
    near = reduce(
        lambda rest, kind: F.when(low.rlike(BEFORE[kind]), F.lit(kind)).otherwise(rest), KINDS,
        F.when(low.rlike(NOT_PERSONAL), F.lit("other")).otherwise(F.lit("-")),
    )
    shape = F.substring(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]+", "a"), 1, 20)

    def hashed(v: Column, n: int) -> Column:  # free forms are hashed to n values
        return F.pmod(F.xxhash64(v), F.lit(n))

    values = {
        "digits": F.least(F.length(digits), F.lit(24)), "marks": hashed(marks, 64), "near": near, "shape": hashed(shape, 256),
        "plus": value.startswith("+"), "luhn": _luhn(digits), "issuer": digits.rlike(ISSUERS),
        "country": value.rlike(COUNTRY_CODES), "ip": value.rlike(IP_PARTS), "domain": value.rlike(DOMAINS),
    }
    return F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("-"))) for k, v in values.items()])


def _cut(m: Column) -> Column:
    """Candidates of a run of numbers: the run itself up to MOST digits and, from 14 digits, chains of its digit groups.

    All chains of up to CHAIN neighbouring whole groups with 7 to 19 digits are taken, whatever the run's length.
    """
    digits = F.length(_digits(m["value"]))

    def chains(groups: Column) -> Column:
        def of(g: Column, i: Column) -> Column:
            # Members are read by place: a slice would copy the whole array.
            def joined(k: int) -> Column:
                members = [F.coalesce(F.get(groups, i + j)["value"], F.lit("")) for j in range(k)]
                value = F.regexp_replace(F.concat(*members), "[^0-9]+$", "")
                start = m["start"] + g["start"]
                return F.when(i + k <= F.size(groups), F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))

            return F.array(*[joined(k) for k in range(1, CHAIN + 1)])

        made = F.flatten(F.transform(groups, of))
        return F.filter(made, lambda c: c.isNotNull() & F.length(_digits(c["value"])).between(7, 19) & ~((c["start"] == m["start"]) & (c["end"] == m["end"])))

    cut = F.when(digits >= 14, _let(matches(m["value"], GROUP), chains)).otherwise(F.slice(F.array(m), 1, 0))
    return F.concat(F.when(digits.between(7, MOST), F.array(m)).otherwise(F.slice(F.array(m), 1, 0)), cut)


def candidates(text: Column) -> Column:
    """Spans of the wider forms with their votes and features."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    numbers = F.flatten(F.transform(matches(text, NUMBERS), _cut))
    hidden = F.when(text.rlike(r"[(\[]at[)\]]"), matches(text, AT)).otherwise(none)
    emails = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none)

    def described(blocks: Column):
        def block(i: Column) -> Column:
            return F.coalesce(F.get(blocks, i), F.lit(""))

        def of(m: Column) -> Column:
            # Cut from blocks of the text, so that the cost does not grow with its length.
            i, past = F.floor(m["start"] / CONTEXT).cast("int"), (m["start"] % CONTEXT).cast("int")
            before = F.when(i == 0, F.substring(block(i), F.lit(1), past)).otherwise(
                F.substring(F.concat(block(i - 1), block(i)), past + 1, F.lit(CONTEXT))
            )
            return _let(before, lambda b: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                F.array(*labelers(m["value"], b)).alias("votes"), features(m["value"], b).alias("features"),
                F.length(_digits(m["value"])).alias("digits"),
            ))

        return of

    # Most texts have no candidates and are not cut into blocks.
    return _let(F.concat(numbers, hidden, emails), lambda spans: _let(
        F.when(F.size(spans) > 0, _blocks(text, CONTEXT)), lambda blocks: F.transform(spans, described(blocks))
    ))


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


@dataclass
class SpanModel:
    prior: list[float]  # log-probability of each class
    terms: dict[str, list[float]]  # feature: log-probability of its value in each class
    reliability: list[list[list[float]]]  # labeler, class: probability of each vote


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40) -> tuple[list[list[float]], list[list[list[float]]]]:
    """Class probabilities of each vote pattern (votes, count) by expectation-maximisation, and labelers' reliabilities.

    Each labeler has, for each class, a probability of abstaining and of each vote. It starts as
    mostly right where it votes; pseudo-counts keep rare votes from becoming certain.
    """
    k, n_labelers = len(CLASSES), len(patterns[0][0]) if patterns else 0
    start = [[[0.5 if v == 0 else 0.4 if v == c + 1 else 0.1 / (k - 1) for v in range(k + 1)] for c in range(k)] for _ in range(n_labelers)]
    prior, table, posterior = [0.6] + [0.4 / (k - 1)] * (k - 1), start, []
    for _ in range(rounds):
        posterior = []
        for votes, _count in patterns:
            logs = [math.log(prior[c]) + sum(math.log(table[j][c][v]) for j, v in enumerate(votes)) for c in range(k)]
            top = max(logs)
            p = [math.exp(x - top) for x in logs]
            posterior.append([x / sum(p) for x in p])
        mass = [1.0 + sum(p[c] * n for p, (_, n) in zip(posterior, patterns, strict=True)) for c in range(k)]
        prior = [m / sum(mass) for m in mass]
        table = [[[start[j][c][v] * 20 for v in range(k + 1)] for c in range(k)] for j in range(n_labelers)]
        for p, (votes, n) in zip(posterior, patterns, strict=True):
            for j, v in enumerate(votes):
                for c in range(k):
                    table[j][c][v] += p[c] * n
        table = [[[x / sum(row) for x in row] for row in rows] for rows in table]
    return posterior, table


def fit(spans: DataFrame) -> SpanModel:
    """Weigh the labelers and train the classifier on all candidate spans (votes, features).

    Spark sums each feature by vote pattern. Labelers have few votes and features a few hundred values, by
    construction, so the sums that reach the driver do not grow with the corpus.
    """
    each = F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("feature")  # '' counts the span itself
    rows = spans.select("votes", each).groupBy("votes", "feature").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["votes"], r["feature"]))
    listed = [(tuple(r["votes"]), r["n"]) for r in rows if not r["feature"]]
    posterior, table = estimate(listed)
    of = {votes: p for (votes, _), p in zip(listed, posterior, strict=True)}
    mass = [1.0 + sum(of[votes][c] * n for votes, n in listed) for c in range(len(CLASSES))]
    sums: dict[str, list[float]] = {}
    for r in rows:
        if r["feature"]:
            row, p = sums.setdefault(r["feature"], [0.5] * len(CLASSES)), of[tuple(r["votes"])]
            for c in range(len(CLASSES)):
                row[c] += p[c] * r["n"]
    total = sum(mass)
    return SpanModel(
        [math.log(m / total) for m in mass],
        {f: [math.log(x / (m + 1.0)) for x, m in zip(row, mass, strict=True)] for f, row in sums.items()},
        table,
    )


def classified(model: SpanModel, names: Column) -> Column:
    """Class (place in CLASSES) and probability of a span with these features."""
    prior = F.array(*[F.lit(x) for x in model.prior])
    if model.terms:
        terms = F.create_map(*[x for f, row in model.terms.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in row]))])
        logs = F.reduce(names, prior, lambda acc, f: F.zip_with(
            acc, F.coalesce(F.try_element_at(terms, f), F.array(*[F.lit(0.0)] * len(CLASSES))), lambda a, b: a + b
        ))
    else:
        logs = prior

    def pick(v: Column) -> Column:
        top = F.array_max(v)
        weight = F.reduce(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.struct((F.array_position(v, top) - 1).cast("int").alias("class"), (1 / weight).alias("probability"))

    return _let(logs, pick)


def annotated(docs: DataFrame) -> DataFrame:
    """`docs` with __base and __candidates of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__base", base_spans(text)).withColumn("__candidates", candidates(text))


def all_spans(model: SpanModel, sure: float = SURE) -> Column:
    """The base spans, and candidates that the classifier is sure of and that touch no base span and not each other; sorted.

    A card has 13 to 19 digits and a phone number 7 to 15, whatever its surroundings say. One sweep by start: of candidates
    that overlap, the more probable one stays, then the longer, then the earlier.
    """
    judged = F.transform(
        "__candidates", lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["digits"].alias("digits"), classified(model, c["features"]).alias("m")
        )
    )
    sure_ones = F.filter(judged, lambda j: (j["m"]["class"] > 0) & (j["m"]["probability"] >= sure) & F.when(
        j["m"]["class"] == CLASSES.index("card"), j["digits"].between(13, 19)
    ).when(j["m"]["class"] == CLASSES.index("phone"), j["digits"].between(7, 15)).otherwise(True))
    span = "struct<start:bigint,base:boolean,end:bigint,kind:int,p:double>"
    added = F.transform(sure_ones, lambda j: F.struct(
        j["start"], F.lit(False), j["end"], (j["m"]["class"] - 1), j["m"]["probability"]
    ).cast(span))
    base = F.transform("__base", lambda s: F.struct(s["start"], F.lit(False), s["end"], s["kind"], F.lit(2.0)).cast(span))

    def step(acc: Column, s: Column) -> Column:
        last, is_base = acc["last"], s["p"] > 1
        apart = last.isNull() | (s["start"] >= last["end"])
        better = (s["p"] > last["p"]) | ((s["p"] == last["p"]) & (s["end"] - s["start"] > last["end"] - last["start"]))
        covered = ~is_base & (s["start"] < acc["base_end"])
        out = F.when(~covered & apart & last.isNotNull(), F.concat(acc["out"], F.array(last))).otherwise(acc["out"])
        # A base span ends the waiting candidate: taken if it is apart, dropped if they touch.
        waiting = F.when(covered, last).when(is_base, F.lit(None)).when(apart | better, s).otherwise(last)
        return F.struct(
            waiting.cast(span).alias("last"), out.alias("out"),
            F.when(is_base, F.greatest(acc["base_end"], s["end"])).otherwise(acc["base_end"]).alias("base_end"),
        )

    start = F.struct(
        F.lit(None).cast(span).alias("last"), F.array().cast(f"array<{span}>").alias("out"), F.lit(0).cast("long").alias("base_end")
    )
    swept = F.reduce(F.array_sort(F.concat(added, base)), start, step, lambda acc: F.concat(acc["out"], F.filter(
        F.array(acc["last"]), lambda s: s.isNotNull()
    )))
    chosen = F.transform(swept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(F.size(sure_ones) == 0, F.array_distinct("__base")).otherwise(
        F.array_sort(F.array_distinct(F.concat("__base", chosen)))
    )


def _votes(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("__candidates").alias("c")).select("c.votes", "c.features")


def detect(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id, `base` and `spans` of each row: arrays of start, kind (place in KINDS), end, sorted.

    `base` has the fixed forms. `spans` has these and the spans of wider forms that touch none of
    them and that the classifier, trained on the labelers' weighted votes over all rows, takes for
    personal data with at least the probability `sure`. Null and empty texts have no spans;
    repeated rows are treated alike; a null doc_id stays null; an empty table gives an empty one;
    other columns are ignored.
    """
    found = settled(annotated(docs.select("doc_id", "text")).select("doc_id", "__base", "__candidates"))
    model = fit(_votes(found))
    return found.select("doc_id", F.col("__base").alias("base"), all_spans(model, sure).alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def redacted(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in brackets; of overlapping spans the text they cover goes once."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    size = 256

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        # Characters a to b, cut from blocks, so that the cost does not grow with what precedes them.
        i, j = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
        past = (a % size).cast("int") + 1
        return F.when(i == j, F.substring(first, past, (b - a).cast("int"))).otherwise(F.concat(
            F.substring(first, past, F.lit(size)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
            F.substring(last, F.lit(1), (b % size).cast("int")),
        ))

    def folded(blocks: Column) -> Column:
        # Text from the furthest end so far up to each span's start, then its mark.
        made = F.reduce(
            spans,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(
                    piece(blocks, acc["at"], s["start"]), F.get(names, s["kind"])
                ))).otherwise(acc["out"]).alias("out"),
            ),
        )
        return _let(made, lambda f: F.concat(F.array_join(f["out"], ""), piece(blocks, f["at"], F.length(text).cast("long"))))

    return F.when(F.size(spans) > 0, _let(_blocks(text, size), folded)).otherwise(text)


def redact(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """`docs`, all columns, with the spans that `detect` finds replaced in text; null texts stay null.

    Texts are scanned twice, once to train and once to replace, and never written in between.
    """
    model = fit(_votes(annotated(docs.select("text"))))
    rows = annotated(docs).withColumn("__spans", all_spans(model, sure))
    return rows.withColumn("text", redacted(F.col("text").cast("string"), F.col("__spans"))).select(*docs.columns)
