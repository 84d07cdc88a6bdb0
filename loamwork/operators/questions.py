"""Questions over topic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import stage
from loamwork.functions.text import has_any, let, sentences, words

# Templates by kind, deepening templates by depth, prefixes of topics, follow-ups by marker.
TEMPLATES = {
    "factual": ("What is {topic}?", "Who created {topic}?", "When did {topic} appear?", "Where is {topic} used?"),
    "procedural": ("How does {topic} work?", "How to implement {topic}?", "How to use {topic} in practice?"),
    "comparative": ("How is {topic} different from {related}?", "Which is better: {topic} or {related}?"),
    "causal": ("Why is {topic} important?", "What factors influence {topic}?", "How does {topic} affect {related}?"),
    "historical": ("What is the history of {topic}?", "How has {topic} evolved over time?"),
    "future": ("What is the future of {topic}?", "What are the development trends of {topic}?"),
}
DEPTHS = {1: ("factual",), 2: ("factual", "procedural", "comparative"), 3: tuple(TEMPLATES)}
DEEPENING = ("Что такое {}?", "Как работает {}?", "Какие существуют разновидности {}?", "Каковы перспективы развития {}?")
PREFIXES = ("что такое ", "кто такой ", "кто такая ", "как ", "почему ", "зачем ", "what is ", "who is ", "how to ", "why ")
STOP_TERMS = ("это", "что", "как", "так", "когда", "где", "кто", "какой", "также", "очень", "сам", "весь", "мой", "твой", "наш", "ваш", "свой", "эти", "этой", "этого", "которые", "который")
MARKERS = (
    (("потому что", "так как"), "Почему это важно для {}?"),
    (("например", "к примеру"), "Какие еще примеры {} существуют?"),
    (("является",), "Каковы основные характеристики {}?"),
    (("используется",), "Где еще можно применить {}?"),
)
GENERIC = "similar concepts"
VARIED = ("Что такое", "Кто такой")
VARIATIONS = ("Расскажи о {}", "Информация о {}", "Подробнее о {}")
HOW, COMPARISON = ("как", "способ", "метод", "инструкция"), ("сравнить", "лучше", "хуже", "чем", "против")


def research_questions(topics: DataFrame, related: DataFrame, depth: int, n: int, seed: str = "q", stop: tuple[str, ...] = (), varied: tuple[str, ...] = VARIED) -> DataFrame:
    """topic, place, question: the templates of the kinds of a depth, max(1, n / kinds) of each kind by seeded order.

    {related} becomes each related topic (topic, related), or a generic phrase. Questions that hold one of `varied` are
    followed by VARIATIONS. Those of 10 to 200 characters without stop phrases, each once, the first n. The templates are a constant table, so it is broadcast.
    """
    kinds = DEPTHS[min(max(depth, 1), 3)]
    per = max(1, n // len(kinds))
    rows = [(k, i, t) for k in kinds for i, t in enumerate(TEMPLATES[k])]
    table = topics.sparkSession.createDataFrame(rows, "kind string, i int, template string")
    mixed = topics.select("topic").distinct().crossJoin(F.broadcast(table))
    w = Window.partitionBy("topic", "kind").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "topic", "template")))
    chosen = mixed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per)
    other = chosen.join(related, "topic", "left").withColumn("related", F.coalesce("related", F.lit(GENERIC)))
    q = F.replace(F.replace("template", F.lit("{topic}"), F.col("topic")), F.lit("{related}"), F.col("related"))
    more = [F.concat(F.lit(x.split("{}")[0]), "topic") for x in VARIATIONS]
    every = other.select("topic", "kind", "r", q.alias("q")).select("topic", "kind", "r", F.posexplode(F.when(has_any(F.col("q"), varied), F.array("q", *more)).otherwise(F.array("q"))).alias("v", "question"))
    made = every.where((F.length("question") >= 10) & (F.length("question") <= 200) & ~has_any(F.lower("question"), stop))
    first = made.groupBy("topic", "question").agg(F.min(F.struct("kind", "r", "v")).alias("at"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy("at", "question")).cast("long")
    return first.withColumn("place", place).where(F.col("place") <= n).select("topic", "place", "question")


def clean_topic(topic: Column) -> Column:
    """Trimmed, without final question marks and one of the prefixes."""
    t = F.regexp_replace(F.trim(topic), r"\?+$", "")
    return F.trim(F.regexp_replace(t, "(?iu)^(" + "|".join(PREFIXES) + ")", ""))


HEAD = 600


def _first_terms(text: Column, n: int) -> Column:
    """good, long: the first n distinct terms of each kind (term, pos), and how many words are of the first kind (3 at most)."""
    def ok(c: Column) -> Column:
        first = F.left(c, F.lit(1))
        return (F.length(c) >= 5) & ((first != F.lower(first)) | (F.length(c) >= 7)) & ~F.lower(c).isin(*STOP_TERMS) & c.rlike(r"^\p{L}+$")

    def firsts(all_: Column, some: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(some), 1, n), lambda t: F.struct(t.alias("term"), F.array_position(all_, t).alias("pos")))

    def found(raw: Column, bare: Column) -> Column:
        long_ = F.filter(raw, lambda x: (F.length(x) > 5) & x.rlike(r"^\p{L}+$"))
        return let(F.filter(bare, ok), lambda good: F.struct(firsts(bare, good).alias("good"), firsts(raw, long_).alias("long"), F.least(F.size(good), F.lit(3)).alias("n")))

    strip = lambda x: F.regexp_replace(x, r"^[.,!?;:()\[\]{}«»\"]+|[.,!?;:()\[\]{}«»\"]+$", "")
    return let(words(text), lambda raw: let(F.transform(raw, strip), lambda bare: found(raw, bare)))


def deepening_questions(rows: DataFrame, depth: int, n: int = 5, head: int = HEAD) -> DataFrame:
    """topic, place, question about the first n distinct terms: alphabetic words of 5 letters, capitalised or of 7, no stop
    words; if there are under 3, words of over 5 letters follow. rows: topic, seq, text.

    Only the first n distinct terms of a row can be among the first n of its topic. They are looked for in the whole words of its
    first `head` characters, and in all of the text where these hold fewer than n, or than 3.
    """
    text = F.col("text")
    cut = F.regexp_replace(F.substring(text, 1, head), r"\S*$", "")  # the last word may go on
    whole = F.length(text) <= head

    def terms(x: Column) -> Column:
        return F.when(whole | ((F.size(x["good"]) >= n) & (x["n"] >= 3)), x).otherwise(_first_terms(text, n))

    x = let(_first_terms(F.when(whole, text).otherwise(cut), n), terms)
    t = stage(rows.where("text IS NOT NULL").select("topic", "seq", x.alias("x")).select("topic", "seq", "x.*"), "first-terms")
    few = t.groupBy("topic").agg(F.sum("n").alias("c")).where("c < 3 OR topic IS NULL").select(F.col("topic").alias("few"))
    good = t.select("topic", "seq", F.explode("good").alias("x")).select("topic", F.lit(0).alias("k"), "seq", "x.pos", "x.term")
    more = t.join(few, F.col("topic").eqNullSafe(F.col("few"))).select("topic", "seq", F.explode("long").alias("x")).select("topic", F.lit(1).alias("k"), "seq", "x.pos", "x.term")
    firsts = good.unionByName(more).groupBy("topic", "term").agg(F.min(F.struct("k", "seq", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy("at")).cast("long")
    a, b = DEEPENING[min(depth, 3)].split("{}")
    return firsts.withColumn("place", place).where(F.col("place") <= n).select("topic", "place", F.concat(F.lit(a), "term", F.lit(b)).alias("question"))


def answer_followups(pairs: DataFrame, n: int = 3, markers=MARKERS) -> DataFrame:
    """id, questions: by the markers that the answer holds, about the cleaned question. pairs: id, question, answer."""
    topic = clean_topic(F.col("question"))
    made = [F.when(has_any(F.col("answer"), m), F.concat(F.lit(t.split("{}")[0]), topic, F.lit(t.split("{}")[1]))) for m, t in markers]
    return pairs.select("id", F.array_join(F.slice(F.filter(F.array(*made), lambda x: x.isNotNull()), 1, n), " | ").alias("questions"))


def topic_of(question: Column, keywords: tuple[str, ...]) -> Column:
    """The last two words (of over 2 letters) that follow a keyword, else the first word of over 3 letters without final mark."""

    def found(w: Column) -> Column:
        after = F.filter(F.transform(w, lambda x, i: F.when((i > 0) & F.get(w, i - 1).isin(*keywords) & (F.length(x) > 2), x)), lambda x: x.isNotNull())
        first = F.get(F.filter(w, lambda x: (F.length(x) > 3) & ~x.rlike(r"[?!.]$")), F.lit(0))
        return let(after, lambda a: F.when(F.size(a) > 0, F.array_join(F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), F.lit(2)), " ")).otherwise(first))

    return let(words(F.lower(question)), found)


def question_type(question: Column, how: tuple[str, ...] = HOW, comparison: tuple[str, ...] = COMPARISON) -> Column:
    low = F.lower(question)
    return F.when(has_any(low, how), "how_to").when(has_any(low, comparison), "comparison").when(F.contains(question, F.lit("?")), "factual").otherwise("general")


def question_topics(questions: DataFrame, keywords: tuple[str, ...], n: int = 10, how: tuple[str, ...] = HOW, comparison: tuple[str, ...] = COMPARISON) -> DataFrame:
    """topic, n, how_to, comparison, factual, general (questions of each type) of the n commonest topics."""
    t = questions.select(topic_of(F.col("question"), keywords).alias("topic"), question_type(F.col("question"), how, comparison).alias("type")).where("topic IS NOT NULL")
    kinds = [F.count(F.when(F.col("type") == k, 1)).alias(k) for k in ("how_to", "comparison", "factual", "general")]
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), *kinds).orderBy(F.desc("n"), "topic").limit(n)


def last_alike(topics: DataFrame, n: int) -> DataFrame:
    """topic, related: the last other topic that begins with the same n characters; topics without one have no row.

    That is the last of all, or for this one the last but one, so no pairs are formed. topics: topic, nulls are left out.
    """
    t = topics.where("topic IS NOT NULL").select("topic").distinct().withColumn("p", F.substring("topic", 1, n))
    last = t.groupBy("p").agg(F.max("topic").alias("last"))
    marked = t.join(last, "p")
    next_ = marked.where("topic <> last").groupBy("p").agg(F.max("topic").alias("next"))
    both = t.join(last.join(next_, "p"), "p")
    return both.select("topic", F.when(F.col("topic") == F.col("last"), F.col("next")).otherwise(F.col("last")).alias("related"))


def followups(questions: DataFrame, related: DataFrame, keywords: tuple[str, ...], fillers: tuple[str, ...], n: int = 3) -> DataFrame:
    """id, place, question: about the topic, then about related topics (topic, related), then fillers; each once."""
    q = stage(questions.select("id", topic_of(F.col("question"), keywords).alias("topic")), "question-topics")
    main = q.where("topic IS NOT NULL").select("id", F.lit(0).alias("k"), F.col("topic").alias("o"), F.concat(F.lit("Tell more about "), "topic").alias("question"))
    near = q.join(related, "topic").select("id", F.lit(1).alias("k"), F.col("related").alias("o"), F.concat(F.lit("What is "), "related", F.lit("?")).alias("question"))
    fill = q.select("id", F.lit(2).alias("k"), F.posexplode(F.array(*map(F.lit, fillers))).alias("i", "question")).select("id", "k", F.lpad(F.col("i").cast("string"), 3, "0").alias("o"), "question")
    first = main.unionByName(near).unionByName(fill).groupBy("id", "question").agg(F.min(F.struct("k", "o")).alias("at"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("at", "question")).cast("long")
    return first.withColumn("place", place).where(F.col("place") <= n).select("id", "place", "question")


def statement_questions(answers: DataFrame, n: int = 2) -> DataFrame:
    """id, questions: "Правда ли, что ...?" for the first n sentences of over 20 characters and 3 words. answers: id, answer."""
    s = F.filter(sentences(F.col("answer")), lambda x: (F.length(x) > 20) & (F.size(words(x)) > 3))
    made = F.transform(F.slice(s, 1, n), lambda x: F.concat(F.lit("Правда ли, что "), F.lower(F.regexp_replace(x, "[.!?]+$", "")), F.lit("?")))
    return answers.select("id", F.array_join(made, " | ").alias("questions")).where("questions <> ''")


def popular_questions(log: DataFrame, topic: str, n: int = 5) -> DataFrame:
    """question, n: the commonest questions that hold the topic, blanks and case aside."""
    q = F.trim(F.regexp_replace(F.lower("question"), r"\s+", " "))
    return log.select(q.alias("question")).where(F.contains("question", F.lit(topic.lower()))).groupBy("question").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question").limit(n)
