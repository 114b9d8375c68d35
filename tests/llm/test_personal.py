import hashlib
import re
import time

import pyarrow.parquet as pq

from quire.llm import personal
from quire.llm.queries import op11_weak_supervision_pii

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d) // 10 + 2 * d % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_force(text):
    out = []
    for k, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}")] * good
    joined = ",".join(x for _, _, x in sorted(out))
    return [sum(k == i for _, k, _ in out) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


ODD = [
    None, "", " ", "a@b.c_d@e.f a@b@c.d x@y. .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 1..2.3.4", "4111 1111 1111 1111 1", "4111-1111-1111-1111, 4111111111111112",
    "é😀 +1 (743) 555-3824) +12 345 +1234567890123456 ++49 30 1234567-", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 00  00", "-" * 1000 + "\n" * 1000, "word," * 3000 + " 4111111111111111",
    "a" * 2000, "1 " * 2000, "a." * 1000 + "@", "9" * 2000, "+1" + " " * 2000, "a@" + "b." * 2000, "1.2.3.4 " * 700, "x@y.z " * 700, "Ann Lee " * 700,
]
#: Texts on which careless patterns take time by the square of the length, and how many of each kind they have.
LONG = [
    ("a" * 300_000, [0, 0, 0, 0]), ("1 " * 150_000, [0, 0, 0, 0]), ("a." * 150_000 + "@", [0, 0, 0, 0]), ("9" * 300_000, [0, 0, 0, 0]), ("+1" + " " * 300_000, [0, 0, 0, 0]),
    ("a@" + "b." * 150_000, [1, 0, 0, 0]), ("1.2.3.4 " * 40_000, [0, 40_000, 0, 0]), ("x@y.z " * 40_000, [40_000, 0, 0, 0]), ("Ann Lee " * 40_000, [0, 0, 0, 0]),
]


def test_long_texts_take_linear_time(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LONG)], "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] for r in personal.base_counts(df).collect()}
    assert got == {i: n for i, (_, n) in enumerate(LONG)} and time.time() - began < 120


def test_base_spans_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, "a@b.c", "y"), (None, None, "z")], "doc_id long, text string, spans string").repartition(4)
    rows = sorted(map(tuple, personal.personal_spans(df).drop("spans").collect()), key=str)
    want = [(i, *c, h) for i, (c, h, _) in enumerate(map(brute_force, ODD))] + [(0, *brute_force("a@b.c")[0], brute_force("a@b.c")[1]), (None, *brute_force("")[0], brute_force("")[1])]
    assert rows == sorted(want, key=str)
    assert personal.personal_spans(df.limit(0)).count() == 0


def test_whole_table(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()}
    for r in op11_weak_supervision_pii(spark, tiny).collect():
        counts, sha, joined = brute_force(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == sha
        assert r["spans"] == joined  # clean texts get no more spans


PLANTED = [
    ("ssn", "My social security number is {}, thanks.", ["123-45-6789", "219-09-9999", "457-55-5462"]),
    ("iban", "Please transfer it to account {} today.", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]),
    ("local", "You can call (415) 555-0132 or phone {} at noon.", ["415-555-2671", "(212) 555-0187", "646.555.0199"]),
    ("person", "Yours sincerely, the customer name is {} and no other.", ["John Smith", "Maria Garcia", "Peter K. Miller"]),
    ("street", "She lives at {} near the river.", ["42 Baker Street", "7 Green Hill Road", "1600 Long Oak Avenue"]),
    ("birth", "He was born on {} in the north.", ["12/04/1981", "1979-11-30", "5 January 1990"]),
    ("ipv6", "The server has the address {} now.", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
]
CLEAN = ["Version 415-555-2671 of the model order 000-00-0000 was built.", "The Old Bridge crossed by Red Oak.", "See section 12/04/1981 of release 1979-11-30.", "Account XX00 1234 5678 9012 holds nothing.", "Fig 123-45-6789 in chapter 3 shows model 0:0:0:0:0:0:0:0 page 1.", "one two three 2024 4.5 7/8"]


def test_planted_spans_are_added_and_clean_texts_left_alone(spark):
    rows, want = [], {}
    for kind, frame, values in PLANTED:
        for v in values:
            for _ in range(5):
                text = frame.format(v)
                want[len(rows)] = f"{kind}:{text.index(v)}:{text.index(v) + len(v)}"
                rows.append((len(rows), text))
    planted = len(rows)
    rows += [(planted + i, t) for i, t in enumerate(CLEAN * 5)]
    rows += [(len(rows) + i, f"write to joe{i}@mail.example.com or call +1 (212) 555-01{i:02d}") for i in range(40)]
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in personal.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[i] in got[i] for i in want) >= 0.9 * len(want)
    assert sum(bool(got[planted + i]) for i in range(len(CLEAN) * 5)) == 0


def test_sums_over_long_arrays(spark):
    from pyspark.sql import functions as F

    steps = list(range(1000))
    df = spark.createDataFrame([(steps,), ([],), ([5],)], "s array<long>").select(personal._sums(F.col("s")).alias("at"))
    got = [r["at"] for r in df.collect()]
    assert sorted(got, key=len) == [[], [0], [sum(steps[:i]) for i in range(1000)]]
