"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, and a span classifier is trained.

Everything is DataFrame expressions.  The base kinds (email, ip, card, phone) are patterns with checks and always reported.  Further kinds
(KINDS[4:]) are only candidates, sought in what the base spans leave of the text.  On each span, base ones included, six labelers vote
for, against or not at all: strict form and checksums, gazetteers, cue words before it, cues against it, what touches it, and
degenerate digits.  Expectation maximisation (Dawid and Skene's model, silence being a vote too) estimates from the counts of
vote patterns how common each kind is and how much each vote tells; its posteriors are the targets of a logistic regression over kind,
votes, the word before (hashed) and length.  A candidate is reported if a labeler votes for it and its probability is THRESHOLD or more.

A span is stored as its place and a cell of features, of which there are at most CELLS; both fits run on counts by cell, so they see all
spans of all texts and the driver gets sums by feature. Texts are read once, without a shuffle, and every pattern runs in linear time.

Nulls count as empty texts: zero counts, empty spans. Rows are independent, so repeated rows and ids repeat their results. Base spans
are in the order of start and kind, so there are no ties. Spans of different kinds may overlap; candidates do not overlap each other.
Extra columns are ignored, an empty table gives an empty result, long texts count whole. A span's context is what stands between it and
the match before it, 32 characters at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.tables import forget, stored

KINDS = ("email", "ip", "card", "phone", "local", "ssn", "iban", "ipv6", "birth", "street", "person")
LABELERS = ("form", "gazetteer", "cue", "counter-cue", "edges", "digits")
BASE = 4
CONTEXTS, LENGTHS = 16, (8, 12, 16, 24)
VOTES = 3 ** len(LABELERS)
CELLS = len(KINDS) * VOTES * CONTEXTS * (len(LENGTHS) + 1)
THRESHOLD = 0.5
EM_ROUNDS, FIT_ROUNDS = 12, 25
#: What votes against, none and votes for weigh before any are seen, in spans; for personal data and for the rest.
PRIOR = ((1.0, 7.0, 12.0), (10.0, 9.0, 1.0))

# Patterns that match what the stated ones do, in linear time: runs are possessive, and no match begins inside a run that has failed.
EMAIL = r"[A-Za-z0-9._%+-](?:(?<=\G.)|(?<![A-Za-z0-9._%+-].))[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9].)(?<![0-9][ -].)(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"  # whole runs of 14 to 19 digits
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Months, kinds of streets, and names that are common in the languages of the corpus.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Ct|Square|Terrace|Place|Way"
FIRST_NAMES = """Adam Alexander Alice Amelia Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carmen Caroline Catherine Charles
Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Francisco Frank
George Gabriel Hannah Hans Heather Helen Helga Henry Ines Isabel Jack Jacob James Jane Javier Jean Jennifer Jessica Joan John Jonathan Jorge Joseph Juan
Julia Julie Karen Karl Katherine Kevin Klaus Laura Linda Lisa Louis Louise Lucas Lucia Luis Manuel Marc Margaret Maria Marie Mark Martin Mary Matthew Michael Michelle
Miguel Monika Nancy Natalie Nicholas Nicole Olivia Pablo Patricia Patrick Paul Pedro Peter Petra Philip Pierre Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra
Sara Sarah Sebastian Sofia Sophie Stefan Stephen Susan Teresa Thomas Ursula Victor Victoria Werner William Wolfgang""".split()
LAST_NAMES = """Adams Allen Anderson Baker Bauer Becker Bernard Brown Campbell Carter Clark Collins Davies Davis Diaz Dubois Durand Edwards Evans Fischer Fernandez Garcia Gomez
Gonzalez Green Hall Harris Hernandez Hill Hoffmann Hughes Jackson Johnson Jones King Klein Koch Lambert Laurent Lee Lefebvre Lewis Lopez Martin Martinez Meyer Miller
Mitchell Moore Moreau Morgan Morris Müller Nelson Parker Perez Petit Phillips Richter Roberts Robinson Rodriguez Sanchez Schmidt Schneider Schulz Scott Simon Smith Taylor
Thomas Thompson Torres Turner Wagner Walker Watson Weber White Williams Wilson Wolf Wood Wright Young""".split()
#: Countries whose account numbers have a fixed length, first digits of card issuers, country calling codes of one and two digits.
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_NAME = r"\p{Lu}[\p{L}]++"
CANDIDATES = {
    "local": r"(?<![0-9A-Za-z+./-])(?<!\+[0-9]{1,3} )\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z./-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "birth": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}} (?:{MONTHS}) (?:19|20)[0-9]{{2}}|(?:{MONTHS}) [0-9]{{1,2}}, (?:19|20)[0-9]{{2}})(?![0-9A-Za-z]|[./-][0-9])",
    "street": rf"(?<![0-9A-Za-z.,/-])[0-9]{{1,5}} (?:{_NAME} ){{1,3}}(?:{STREETS})(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}0-9_@.'-]){_NAME}(?: \p{{Lu}}\.)?(?: {_NAME}){{1,2}}(?![\p{{L}}0-9_@])",
}
#: One pattern for all candidates. What base patterns match is consumed with it, so that candidates are hardly ever parts of base spans.
CANDIDATE = r"(?<![\p{L}0-9])(?=[+(0-9\p{Lu}a-f])(?:" + "|".join((PHONE, CARD, *CANDIDATES.values())) + ")"
CUES = {
    "email": r"e-?mail|contact|write to|reach", "ip": r"\bip\b|address|host|server|from", "card": r"card|visa|master|credit|debit|pay", "phone": r"phone|tel\b|call|mobile|fax|cell|contact",
    "local": r"phone|tel\b|call|mobile|fax|cell|contact|dial", "ssn": r"\bssn\b|social|security|tax|taxpayer", "iban": r"iban|account|bank|transfer|bic", "ipv6": r"\bip|address|host|server",
    "birth": r"born|birth|\bdob\b|birthday", "street": r"address|lives?|living|resid|located|home|\bat\b", "person": r"(?:\bmr|\bmrs|\bms|\bdr|\bprof)\.? ?$|name(?: is|:)|\bdear |signed|patient|customer|contact|sincerely",
}
_AGAINST = r"version|\bv\.? ?$|isbn|issn|doi|figure|\bfig\b|section|chapter|page|\border|rfc|build|release|ratio|serial|model|equation"


def _sums(steps: Column) -> Column:
    """Sum of the elements before each of an array of longs; runs of 256 are summed by themselves, as an array grows by copying."""
    run, long = 256, lambda n: F.lit(n).cast("long")
    grown = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<long>").alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(run))).otherwise(F.array().cast("array<int>"))
    totals = F.transform(starts, lambda i: F.aggregate(F.slice(steps, i, run), long(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(starts, grown(totals, long(0)), lambda i, at: grown(F.slice(steps, i, run), at)))


def _kind(m: Column) -> Column:
    """The candidate kind of what CANDIDATE matched, null for the base kinds."""
    tests = {
        None: "[@+]", "ipv6": ":", "iban": "^[A-Z]{2}[0-9]{2}", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "birth": rf"[0-9].*(?:{MONTHS})|(?:{MONTHS}).*[0-9]|^[0-9]{{1,4}}[./-][0-9]{{1,2}}[./-]",
        "street": r"^[0-9]+ \p{L}", "local": r"^\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$", "person": "^[^0-9]+$",
    }
    out = F
    for kind, pattern in tests.items():
        out = out.when(m.rlike(pattern), F.lit(kind).cast("string"))
    return out


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _with_matches(rows: DataFrame, pattern: str, likely: Column) -> DataFrame:
    """rows with x: the matches of pattern in t as a, b (code points, end exclusive), m, and the texts before and after each."""
    rows = rows.withColumn("m", F.when(likely, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("p", F.when(F.size("m") > 0, F.split("t", pattern, -1)).otherwise(F.array(F.lit(""))))
    steps = F.zip_with("m", F.slice("p", 1, F.size("m")), lambda m, p: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m")))
    rows = rows.withColumn("s", steps).withColumn("n", F.transform("s", lambda x: x["p"] + x["m"])).withColumn("at", _sums(F.col("n")))
    span = lambda x, i: F.struct((F.get("at", i) + x["p"]).alias("a"), (F.get("at", i) + x["p"] + x["m"]).alias("b"), F.get("m", i).alias("m"), F.right(F.get("p", i), F.lit(32)).alias("before"), F.left(F.get("p", i + 1), F.lit(12)).alias("after"))
    return rows.withColumn("x", F.transform("s", span)).drop("m", "p", "s", "n", "at")


#: Whether a match of a base pattern is one of its kind.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _iban(m: Column) -> Column:
    """Whether the check digits of an account number hold: letters become 10 to 35, and nine digits at a time are divided by 97."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
    numbers = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(F.filter(numbers, lambda x: x >= 0), F.lit(0).cast("long"), lambda at, x: F.when(x > 9, at * 100 + x).otherwise(at * 10 + x) % 97) == 1


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 for silence; what can't be told is silent."""
    out = F.when(yes, 2)
    return (out if no is None else out.when(no, 0)).otherwise(1)


def _votes(kind: str, x: Column) -> list[Column]:
    """What the labelers say of a span, in the order of LABELERS."""
    m, digits, never = x["m"], _digits(x["m"]), F.lit(False)
    word = lambda i: F.get(F.split(m, " "), i)
    one_of = lambda c, values: c.rlike(f"^(?:{'|'.join(values)})$")
    country = F.left(m, F.lit(2))
    form = {
        "email": lambda: (m.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$"), m.rlike(r"\.[0-9-]+$")),
        "ip": lambda: (m.rlike(r"^(?!0)(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": lambda: (F.call_function("luhn_check", digits) & digits.rlike("^[3-6]"), ~F.call_function("luhn_check", digits)),
        "phone": lambda: (F.length(digits).between(10, 15), F.length(digits) > 15),
        "local": lambda: (digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[2-9](.)\\1")),
        "ssn": lambda: (m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "iban": lambda: (_iban(m), ~_iban(m)),
        "ipv6": lambda: (m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), m.rlike("^[0:]+$")),
        "birth": lambda: (never, m.rlike(r"^(?:[4-9][0-9]|3[2-9])[./-]|[./-](?:[4-9][0-9]|3[2-9])[./-]")),
        "street": lambda: (m.rlike(r"^[1-9]"), m.rlike("^0")),
        "person": lambda: (never, m.rlike(r"\b(?:The|This|That|And|But|For|With|License|University|Inc|Ltd|Street)\b")),
    }[kind]()
    gazetteer = {
        "iban": lambda: (one_of(country, IBAN_COUNTRIES), ~one_of(country, IBAN_COUNTRIES)),
        "phone": lambda: (digits.rlike(f"^(?:{'|'.join(CALLING_CODES)})"), digits.startswith("0")),
        "card": lambda: (digits.rlike("^(?:4|5[1-5]|3[47]|6011|65|35)"), digits.rlike("^[0-2]")),
        "person": lambda: (one_of(word(0), FIRST_NAMES) | one_of(F.element_at(F.split(m, " "), -1), LAST_NAMES) & word(0).rlike(r"^\p{Lu}\p{Ll}+$"), never),
        "street": lambda: (one_of(F.element_at(F.split(m, " "), -1), STREETS.split("|")), never),
        "ip": lambda: (m.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), m.rlike(r"^(?:0|127|255)\.")),
        "email": lambda: (never, m.rlike(r"@(?:example|test|localhost)\.")),
    }.get(kind, lambda: (never, never))()
    before = F.lower(x["before"])
    return [
        _vote(*form),
        _vote(*gazetteer),
        _vote(before.rlike(CUES[kind])),
        _vote(never, before.rlike(_AGAINST)),
        _vote(never, x["before"].rlike(r"[\p{L}0-9_/=#&]$") | x["after"].rlike(r"^[\p{L}0-9_/=%]")),
        _vote(never, digits.rlike(r"^(.)\1+$|0123456|1234567|9876543") if kind not in ("person", "street", "email") else never),
    ]


def _cell(kind: str, x: Column) -> Column:
    """Kind, votes, context and length of a span as one number."""
    code = F.lit(KINDS.index(kind))
    for v in _votes(kind, x):
        code = code * 3 + v
    word = F.regexp_extract(F.lower(x["before"]), r"([\p{L}]+)[^\p{L}]*$", 1)
    n = sum((F.length(x["m"]) > k).cast("int") for k in LENGTHS)
    return ((code * CONTEXTS + F.pmod(F.xxhash64(word), F.lit(CONTEXTS)).cast("int")) * (len(LENGTHS) + 1) + n).cast("int")


def _features(code: Column) -> Column:
    """Places of a cell's features in the weights (from 1): kind, votes, context, length."""
    lengths = len(LENGTHS) + 1
    rest = F.floor(code / (lengths * CONTEXTS)).cast("int")
    votes = [F.lit(1 + len(KINDS) + 3 * i) + F.floor(rest / 3 ** (len(LABELERS) - 1 - i)).cast("int") % 3 for i in range(len(LABELERS))]
    first = 1 + len(KINDS) + 3 * len(LABELERS)
    return F.array(1 + F.floor(rest / VOTES).cast("int"), *votes, first + F.floor(code / lengths).cast("int") % CONTEXTS, first + CONTEXTS + code % lengths)


FEATURES = len(KINDS) + 3 * len(LABELERS) + CONTEXTS + len(LENGTHS) + 1


def _margin(features: Column, weights: list[float]) -> Column:
    held = F.expr(f"array({', '.join(f'{w!r}D' for w in weights)})")
    return F.aggregate(features, F.lit(0.0), lambda s, f: s + F.element_at(held, f))


def spans_found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, its base spans by start and kind, and its candidates, each as a, k (place in KINDS), b, cell."""
    t = F.col("t")
    kept = lambda kind: lambda x: F.struct(x["a"].alias("a"), F.lit(KINDS.index(kind)).alias("k"), x["b"].alias("b"), _cell(kind, x).alias("cell"))
    good = lambda kind: lambda x: CHECKS[kind](x["m"])
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    likely = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9][ -]?[0-9]"), "phone": t.contains("+")}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        rows = _with_matches(rows, pattern, likely[kind])
        rows = rows.withColumn(kind, F.transform(F.filter("x", good(kind)), kept(kind))).drop("x")
    rows = _with_matches(rows, CANDIDATE, F.lit(True))
    each = lambda x: F.struct(_kind(x["m"]).alias("kind"), *(x[c].alias(c) for c in ("a", "b", "m", "before", "after")))
    rows = rows.withColumn("x", F.filter(F.transform("x", each), lambda x: x["kind"].isNotNull()))
    of = lambda kind: F.transform(F.filter("x", lambda x: x["kind"] == kind), kept(kind))
    base = F.array_sort(F.concat(*KINDS[:BASE]))
    return rows.select("id", base.alias("base"), F.concat(*(of(kind) for kind in KINDS[BASE:])).alias("candidates"))


def _estimated(cells: DataFrame) -> list[float]:
    """Weights of kinds and votes whose sum is the log-odds that a span is personal data, by expectation maximisation over counts."""
    kinds, theta = len(KINDS), [0.0] * FEATURES
    prior = [[x / sum(side) for x in side] for side in PRIOR]
    for i in range(len(LABELERS)):
        theta[kinds + 3 * i : kinds + 3 * i + 3] = [math.log(prior[0][v] / prior[1][v]) for v in range(3)]
    used = F.slice("features", 1, 1 + len(LABELERS))  # kind and votes
    for _ in range(EM_ROUNDS):
        p = 1 / (1 + F.exp(-_margin(used, theta)))
        sums = {f: (yes, no) for f, yes, no in cells.select("n", p.alias("p"), F.explode(used).alias("f")).groupBy("f").agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))).collect()}
        for f in range(kinds):
            yes, no = sums.get(f + 1, (0.0, 0.0))
            theta[f] = round(math.log((yes + 1) / (no + 1)), 6)
        for i in range(len(LABELERS)):
            share = []
            for side in (0, 1):
                seen = [sums.get(1 + kinds + 3 * i + v, (0.0, 0.0))[side] + PRIOR[side][v] for v in range(3)]
                share.append([x / sum(seen) for x in seen])
            told = [math.log(share[0][v] / share[1][v]) for v in range(3)]
            theta[kinds + 3 * i : kinds + 3 * i + 3] = [round(x, 6) for x in (min(told[0], 0.0), told[1], max(told[2], 0.0))]  # labelers are no worse than chance
    return theta


def _trained(cells: DataFrame, theta: list[float]) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, by steps that bound the loss from above feature by feature."""
    weights, active = [0.0] * FEATURES, 3 + len(LABELERS)
    target = 1 / (1 + F.exp(-_margin(F.slice("features", 1, 1 + len(LABELERS)), theta)))
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + F.exp(-_margin(F.col("features"), weights)))
        rows = cells.select("n", (F.col("n") * (target - p)).alias("g"), F.explode("features").alias("f"))
        for f, n, g in rows.groupBy("f").agg(F.sum("n"), F.sum("g")).collect():  # a row a feature
            weights[f - 1] = round(weights[f - 1] + (g - weights[f - 1]) / (active * n / 4 + 1), 6)
    return weights


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["a"].cast("string"), x["b"].cast("string"))), ",")


def _base_columns() -> list[Column]:
    of = lambda k: lambda x: x["k"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return [*counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256")]


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of personal_spans that need no model."""
    return stored(spans_found(df, id_col, text_col), "spans").select(F.col("id").alias(id_col), *_base_columns())


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256 of the base spans, and all spans as kind:start:end."""
    found = stored(spans_found(df, id_col, text_col), "spans")
    each = found.select(F.explode(F.concat("base", "candidates")).alias("x")).groupBy("x.cell").agg(F.count("*").alias("n"))
    cells = stored(each.select("n", _features(F.col("cell")).alias("features")).coalesce(1).sortWithinPartitions("features"), "cells")  # at most CELLS rows
    weights = _trained(cells, _estimated(cells))
    forget(cells)
    vouched = lambda c: F.exists(F.slice(_features(c), 2, len(LABELERS)), lambda f: (f - 1 - len(KINDS)) % 3 == 2)
    limit = math.log(threshold / (1 - threshold))
    added = F.filter("candidates", lambda x: vouched(x["cell"]) & (_margin(_features(x["cell"]), weights) >= limit))
    every = F.when(F.size("candidates") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))
    return found.select(F.col("id").alias(id_col), *_base_columns(), _joined(every).alias("spans"))
