"""Related topics and first terms against plain versions."""

import re

from loamwork.operators import questions as N


def test_last_alike_forms_no_pairs(spark):
    names = [f"abc{i}" for i in range(40)] + ["abd", "xy", "xyz1", "xyz2", "x", None, "abc7"]
    got = {r.topic: r.related for r in N.last_alike(spark.createDataFrame([(x,) for x in names], "topic string"), 3).collect()}
    known = {x for x in names if x}
    want = {t: max(o for o in known if o != t and o[:3] == t[:3]) for t in known if any(o != t and o[:3] == t[:3] for o in known)}
    assert got == want


def test_words_are_split_once(spark):
    """A word's neighbour is read from the split text: one split for each text, not one for each word."""
    from pyspark.sql import functions as F

    plan = spark.range(1).select(N.topic_of(F.col("id").cast("string"), ("the",)).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_deepening_looks_on_where_the_head_is_poor(spark):
    texts = {
        ("a", 1): "tiny words only go on " * 40 + "Alpha, (Bravo) charlie Alpha Deltas! Echoes Foxtrot",
        ("a", 0): "Golfer " * 200 + "Hotels",
        ("b", 5): "little longer words here " * 50,
        ("c", 3): None,
        ("d", 2): "x" * 900,
    }
    df = spark.createDataFrame([(t, s, x) for (t, s), x in texts.items()], "topic string, seq long, text string")
    got = {}
    for r in N.deepening_questions(df, 1, 5, head=60).orderBy("topic", "place").collect():
        got.setdefault(r.topic, []).append(r.question.split()[-1].rstrip("?"))
    want = {}
    for topic in "abcd":
        good, more = [], []
        for (t, _), x in sorted((k, v) for k, v in texts.items() if k[0] == topic and v):
            raw = x.split()
            bare = [re.sub(r'^[.,!?;:()\[\]{}«»"]+|[.,!?;:()\[\]{}«»"]+$', "", w) for w in raw]
            good += [c for c in bare if len(c) >= 5 and (c[0] != c[0].lower() or len(c) >= 7) and c.lower() not in N.STOP_TERMS and c.isalpha()]
            more += [c for c in raw if len(c) > 5 and c.isalpha()]
        terms = list(dict.fromkeys(good + (more if len(good) < 3 else [])))[:5]
        if terms:
            want[topic] = terms
    assert got == want
