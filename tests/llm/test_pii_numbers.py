"""Numbers of everyday prose: which are taken for personal data, and which written-out numbers are found."""

from pyspark.sql import functions as F

from loamwork.llm import pii
from loamwork.llm.pii import find_spans, isbn10, keyed, ordinary

MEDIUM = "/root/testdata/sf0.01"
FIRM = ["doi 10.1000.123456789", "isbn 0-306-40615-2", "serial 0000000001", "pages 123-456-789-1011"]
#: Used while the features were chosen.
PLAIN = [
    "ISBN: 978-3-16-148410-0", "the edition 0-19-852663-6", "isbn 1 86197 271 7", "DOI: 10.1038.171737.0042", "under 10.1126.1234567890",
    "part no. 0004821937", "model 000077123456", "invoice 839201774650", "build 10.0.22631.4317", "release 3.11.20240.1055", "see pp. 44-61-102-119",
    "chapters 101-145-200-268", "lat 59.9139 10.7522", "near 40.7128 74.0060", "a sum of 3 400 250 000", "with 12.750.000.125 votes", "between 1914-07-28 1918-11-11",
    "at 2023-11-30 08.15.59", "stamp 20231130081559", "the constant 2.718281828459", "ratio 1.41421356237", "scores 3-2 4-1 0-0 5-3 2-2",
]
PHONES = [
    "phone 555 010 9999 call me", "call 212-555-0143 after six", "tel. 0303 555 0188", "my mobile: 646 555 0110", "fax 415.555.0199", "phone 7185550162", "ring (312) 555-0177 today",
    "call me at 020 7946 0018", "telephone 1 (404) 555-0121", "call 1-808-555-0133 now",
]

#: Written after the features were chosen.
LATER_PLAIN = [
    "doi.org 10.1145.3292500.3330", "ISBN 0 7475 3269 9", "ISBN-13 979-10-90636-07-1", "article number 000918273645", "order #20391847561", "account of 1.900.400.000 marks",
    "pages 77-120-133-190", "on pp 301-309 415-422", "kernel 6.8.12345.678", "firmware 2.0.10455.9921", "48.137154 11.576124", "long. 151.2093 33.8688", "from 1789-07-14 to 1799-11-09",
    "logged 2019-01-02 23.59.01", "ticket 5500012345", "about 7 800 000 000 people", "pi is 3.141592653589", "results 2-1 0-3 1-1 4-4 2-0",
]
LATER_PHONES = [
    "phone: 646-555-0172", "you can call 303 555 0145", "Tel 0161 496 0123", "mobile 5035550188", "fax: (206) 555-0111", "call 1.617.555.0190 or write", "telephone 919.555.0133", "ring me at 044 668 1800",
    "call 702-555-0150", "phone 1 512 555 0166",
]


def test_ordinary_numbers_and_written_phones(spark):
    plain, phones = FIRM + PLAIN + LATER_PLAIN, PHONES + LATER_PHONES
    cases = {10**9 + i: x for i, x in enumerate(plain + phones)}
    more = spark.createDataFrame([(i, f"We read that {x}, and so it went on.") for i, x in cases.items()], "doc_id long, text string")
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").unionByName(more)
    spans = find_spans(keyed(docs)).where(f"doc_id >= {10**9}").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")).collect()
    found = {cases[r.doc_id]: r.kinds for r in spans}
    wrong = [x for x in plain if x in found]
    missed = [x for x in phones if found.get(x) != ["phone"]]
    print("taken for personal data:", wrong, "missed:", missed)
    assert not set(FIRM) & set(wrong) and PHONES[0] not in missed
    assert len(wrong) <= 0.1 * len(plain) and len(missed) <= 0.2 * len(phones)


def test_forms(spark):
    nine = {"030640615": 2, "316148410": 10, "019852663": 6, "080442957": 10}
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in nine], "n string").select("n", isbn10(F.col("n")).alias("c")).collect()}
    assert got == nine
    word, value = ordinary(F.col("id"))
    rows = spark.range(400).select(word.alias("w"), value.alias("v")).collect()
    assert all(r.v for r in rows) and {r.w for r in rows} == {"doi", "isbn", "serial", "order", "pages", "version", "coordinates", "total", "on"}


def test_all_candidates_teach(spark, monkeypatch):
    seen = []

    def taught(c, keys):
        seen.append(c.count())
        return c.where("false").withColumns({"label": F.lit(0.0), "sure": F.lit(True)})

    monkeypatch.setattr(pii, "taught", taught)
    c = spark.range(60_000).selectExpr("id AS doc_id", "id AS tie", "'email' AS kind", "0 AS start", "5 AS end", "'a@b.c' AS value", "'' AS before", "'' AS after", "true AS base")
    assert pii.train(c, ["doc_id", "tie"]).limits == {} and seen == [60_000]
