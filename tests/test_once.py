"""Work on texts that is done once for each row."""

from pyspark.sql import functions as F

from loamwork.operators.cleaning import clean_facts
from loamwork.operators.facts import answer_confidence, fact_candidates, is_definition, score_facts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_sentence_are_split_once(spark):
    chunks = spark.createDataFrame([(1, "a", "http://x.org/1", "The old river runs past the quiet town and on to the sea. No! Short. What IS THIS LOUD LINE FULL OF CAPITAL WORDS HERE?")], "doc_id long, topic string, source_url string, text string")
    found = fact_candidates(chunks)
    assert plan(found).count("split(sentence") == 1
    assert [r.pos for r in found.collect()] == [0]


def test_definitions_and_numbers_as_before(spark):
    rows = [("Вода — это вещество", True, 0.3), ("Вода Является веществом", True, 0.3), ("В 1961 году", False, 1.0), ("a12 and 12b", False, 0.0), ("only 7.", False, 0.5), ("МЛН ЛЕТ назад", False, 0.5), (None, False, None)]
    facts = spark.createDataFrame([(i, s, "http://x.org") for i, (s, _, _) in enumerate(rows)], "i long, sentence string, source_url string")
    got = score_facts(facts.withColumn("d", F.coalesce(is_definition(F.col("sentence")), F.lit(False))), [], F.lit(1.0)).orderBy("i").collect()
    assert [r.d for r in got] == [d for _, d, _ in rows]
    assert [round(r.total_score, 6) for r in got][:6] == [x for _, _, x in rows][:6]


def test_facts_are_cleaned_once(spark):
    rows = [(1, "t", 0, "The same long sentence of the river , again."), (2, "t", 0, "the same long sentence of the river, again!"), (3, "t", 1, None), (3, "t", 2, "[1] Another long sentence about the old town.")]
    got = clean_facts(spark.createDataFrame(rows, "doc_id long, topic string, pos int, fact string"), ("junk",))
    assert plan(got).count("regexp_replace(") == 4
    assert [(r.place, r.fact) for r in got.orderBy("place").collect()] == [(1, "The same long sentence of the river, again."), (2, "Another long sentence about the old town.")]


def test_facts_of_confidence_are_found_once(spark):
    read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            read.add(len(b))
            yield b

    facts = spark.createDataFrame([("t", i, "Water boils and water freezes.") for i in range(1, 5)], "topic string, place long, sentence string").mapInPandas(tell, "topic string, place long, sentence string")
    chunks = spark.createDataFrame([("t", 0.8, 1.0, "u"), ("t", 0.6, 0.6, "v")], "topic string, quality double, trust double, source_url string")
    got = answer_confidence(chunks, facts).collect()
    assert [(r.topic, round(r.confidence, 6)) for r in got] == [("t", 0.64)] and read.value == 4
