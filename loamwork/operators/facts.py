"""Facts: candidate sentences, scores, ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import stage
from loamwork.functions.text import AD_MARKERS, FACT_JUNK, LOW_TRUST_HOSTS, PRIORITY_HOSTS, QUESTION_WORDS, STOP_WORDS, has_any, host, let, sentences, words
from loamwork.operators.quality_gate import chunk_quality_gate, length_quality  # noqa: F401
from loamwork.operators.vectors import cosine_links, dot, embed_corpus, hashed_words, semantic_dedup

# Ranking profiles and the patterns that choose them, in order.
PROFILES = {
    "default": {"relevance": 0.35, "domain_credit": 0.30, "position": 0.10, "ner": 0.15, "length": 0.05, "definition_causal": 0.10, "penalty": -0.15, "length_optimal": 120, "steepness": 0.08},
    "factoid": {"relevance": 0.30, "domain_credit": 0.35, "position": 0.05, "ner": 0.35, "length": 0.0, "definition_causal": 0.0, "penalty": -0.15, "length_optimal": 100, "steepness": 0.1},
    "how_why": {"relevance": 0.30, "domain_credit": 0.20, "position": 0.10, "ner": 0.0, "length": 0.0, "definition_causal": 0.40, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "evaluation": {"relevance": 0.50, "domain_credit": 0.25, "position": 0.05, "ner": 0.10, "length": 0.0, "definition_causal": 0.10, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "mathematical_theorem": {"relevance": 0.35, "domain_credit": 0.20, "position": 0.0, "ner": 0.10, "length": 0.0, "definition_causal": 0.35, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "scientific_concept": {"relevance": 0.35, "domain_credit": 0.20, "position": 0.0, "ner": 0.10, "length": 0.0, "definition_causal": 0.35, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "quantum_physics_deep": {"relevance": 0.35, "domain_credit": 0.20, "position": 0.0, "ner": 0.10, "length": 0.0, "definition_causal": 0.35, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "philosophical_concept": {"relevance": 0.30, "domain_credit": 0.20, "position": 0.0, "ner": 0.10, "length": 0.0, "definition_causal": 0.40, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "biological_system": {"relevance": 0.30, "domain_credit": 0.20, "position": 0.0, "ner": 0.10, "length": 0.0, "definition_causal": 0.40, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
    "programming_concept": {"relevance": 0.40, "domain_credit": 0.20, "position": 0.0, "ner": 0.10, "length": 0.0, "definition_causal": 0.30, "penalty": -0.10, "length_optimal": 120, "steepness": 0.08},
    "ai_concept": {"relevance": 0.35, "domain_credit": 0.20, "position": 0.0, "ner": 0.15, "length": 0.0, "definition_causal": 0.30, "penalty": -0.10, "length_optimal": 120, "steepness": 0.08},
    "historical_event": {"relevance": 0.30, "domain_credit": 0.20, "position": 0.1, "ner": 0.35, "length": 0.0, "definition_causal": 0.05, "penalty": -0.10, "length_optimal": 150, "steepness": 0.08},
}
PROFILE_PATTERNS = {
    "philosophical_concept": "философ|сознан|квалиа|субъективн|онтолог|эпистем|феноменолог|бытие|смысл|этик[а]|интенциональност|ницше|кант|хайдеггер|априорн",
    "quantum_physics_deep": r"квантов[аяи]|декогеренц|суперпозиц|шредер|вигнер|волновой\s+функц|корпускуляр|неопределенност|гамильтониан|кхд|струн|эйнштейн",
    "mathematical_theorem": r"теорем[аы]|пифагор|эйлер|ферма|гильберт|аксиом[аы]|формул[аы]|интеграл|производн|дифференц|логарифм|число\s+пи",
    "biological_system": "биологи[яи]|генет|синап|нейрон|эволюц|днк|рнк|симбиоз|транскрипц|белок|фермент|митохондр",
    "programming_concept": r"программир|язык\s+программир|функц[ия]|класс|алгоритм|библиотек[аи]|python|java|c\+\+|javascript|фреймворк|нейросеть|обучение\s+модели",
    "scientific_concept": "физик[а]|хими[я]|космос|астрон|теори[я]|закон|принцип|гипотез[а]|парадокс|эффект|реакция",
    "historical_event": "истори[яи]|событи[ея]|войн[аы]|революц[ия]|биографи[яи]|родился|умер|году|век[а]|империя|царь|король",
    "factoid": r"\bкто\b|\bгде\b|\bкогда\b|\bчто такое\b",
    "how_why": r"\bкак\b|\bпочему\b|\bзачем\b|\bпричина\b",
    "evaluation": r"\bлучше\b|\bхуже\b|\bстоит ли\b|\bсравнить\b|\bотличие\b",
    "ai_concept": "искусственный интеллект|нейросет|машинн[оа]е обучени|гпт|чатгпт|agi|rag|трансформер|llm|ml|ai",
}


def drop_reason(s: Column, junk: tuple[str, ...] = FACT_JUNK, ads: tuple[str, ...] = AD_MARKERS, stop: tuple[str, ...] = STOP_WORDS, asks: tuple[str, ...] = QUESTION_WORDS, keywords: Column | None = None) -> Column:
    """The first rule that drops a sentence, or null. Its words are split once, and only if no rule on the whole sentence drops it."""

    def by_words(w: Column) -> Column:
        n = F.size(w)
        capital = F.size(F.filter(F.slice(w, 2, 100_000), lambda x: F.left(x, F.lit(1)) != F.lower(F.left(x, F.lit(1))))) / F.greatest(n - 1, F.lit(1))
        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(*stop))) / F.greatest(n, F.lit(1))
        head = F.lower(F.get(w, F.lit(0))).isin(*asks) & (F.length(s) < 100)
        if keywords is not None:
            head = head & F.exists(keywords, lambda k: F.contains(F.lower(s), k))
        return F.when((n >= 3) & (capital > 0.4), "capitals").when(stops > 0.6, "stop_words").when(head, "question")

    size = F.when(~F.length(s).between(40, 600), "length")
    phrase = let(F.lower(s), lambda low: F.when(has_any(low, junk), "junk").when(has_any(low, ads), "ad"))
    mark = F.when(s.rlike(r"https?://|www\."), "url").when(F.length(s) - F.length(F.replace(s, F.lit("!"), F.lit(""))) > 2, "shouting")
    return F.coalesce(size, phrase, mark, let(words(s), by_words))


def fact_sentences(chunks: DataFrame) -> DataFrame:
    """doc_id, topic, source_url, of (how many sentences), pos, sentence of every sentence of chunks."""
    s = chunks.select("doc_id", "topic", "source_url", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", "topic", "source_url", F.size("s").alias("of"), F.posexplode("s").alias("pos", "sentence"))


def fact_candidates(chunks: DataFrame, **rules) -> DataFrame:
    """The sentences that no rule drops."""
    return fact_sentences(chunks).where(drop_reason(F.col("sentence"), **rules).isNull())


def score_facts(facts: DataFrame, keywords: list[str] | Column, position: Column, priority: tuple[str, ...] = PRIORITY_HOSTS, low_trust: tuple[str, ...] = LOW_TRUST_HOSTS) -> DataFrame:
    """facts with total_score: keywords held, place, length, digits, dates and definition; times 1.2 or 0.5 by the exact host."""
    s = F.col("sentence")
    low, n, h = F.lower(s), F.length(s), host(F.col("source_url"))
    if isinstance(keywords, Column):  # an array of lower-case words for each row
        base = F.aggregate(keywords, F.lit(0.0), lambda n, k: n + F.contains(low, k).cast("double"))
    else:
        base = sum((F.contains(low, F.lit(k.lower())).cast("double") for k in keywords), F.lit(0.0))
    bonus = F.when(n.between(80, 250), 0.5).when(n.between(251, 400), 0.3).otherwise(0.0)
    some = s.rlike("[0-9]")  # few sentences have digits, and where they stand is dear to ask
    digits = F.when(some & s.rlike(r"(^|[^\p{L}\p{N}_])\d+($|[^\p{L}\p{N}_])"), 0.5).otherwise(0.0)
    dates = F.when((some & s.rlike(r"(^|[^\p{L}\p{N}_])\d{4}($|[^\p{L}\p{N}_])")) | F.contains(low, F.lit("млн лет")), 0.5).otherwise(0.0)
    total = base + (1 - position) + bonus + digits + dates + F.when(is_definition(s), 0.3).otherwise(0.0)
    return facts.withColumn("total_score", total * F.when(h.isin(*priority), 1.2).when(h.isin(*low_trust), 0.5).otherwise(1.0))


def is_definition(s: Column) -> Column:
    return has_any(F.lower(s), ("—", " это ", " является ", "определяет"))


def is_causal(s: Column) -> Column:
    return F.lower(s).rlike("потому что|так как|следовательно|поэтому|из-за|вследствие")


def first_by_prefix(rows: DataFrame, text: str, by: list[str], order: list[str], n: int, lower: bool = True) -> DataFrame:
    """The first row, in `order`, of each prefix of n characters of text (within `by`)."""
    sig = F.substring(F.lower(text) if lower else F.col(text), 1, n)
    w = Window.partitionBy(*by, sig).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_per(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """rows with place, the first n of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def profile_of(query: Column, patterns: dict[str, str] = PROFILE_PATTERNS) -> Column:
    low = F.lower(query)
    return F.coalesce(*(F.when(low.rlike(p), k) for k, p in patterns.items()), F.lit("default"))


def domain_credit(h: Column, priority: tuple[str, ...] = PRIORITY_HOSTS, low_trust: tuple[str, ...] = LOW_TRUST_HOSTS) -> Column:
    return F.when(has_any(h, priority), 1.0).when(has_any(h, low_trust), 0.3).otherwise(0.6)


def rank_facts(facts: DataFrame, profiles: dict[str, dict] = PROFILES) -> DataFrame:
    """facts (profile, relevance, credit, position, ner, sentence) with score by the weights of their profile (default for unknown ones)."""
    spark = facts.sparkSession
    names = list(profiles["default"])
    table = spark.createDataFrame([(k, *(float(v[n]) for n in names)) for k, v in profiles.items()], "p string, " + ", ".join(f"w_{n} double" for n in names))
    known = F.when(F.col("profile").isin(*profiles), F.col("profile")).otherwise("default")
    j = facts.withColumn("p", known).join(F.broadcast(table), "p")
    s = F.col("sentence")
    length = 1 / (1 + F.exp(-(F.length(s) - F.col("w_length_optimal")) * F.col("w_steepness")))
    why = F.least(F.when(is_definition(s), 0.3).otherwise(0.0) + F.when(is_causal(s), 0.2).otherwise(0.0), F.lit(0.5))
    signals = {"relevance": F.col("relevance"), "domain_credit": F.col("credit"), "position": 1 - F.col("position"), "ner": F.least(F.col("ner") / 20, F.lit(1.0)), "length": length, "definition_causal": why}
    score = sum((F.col(f"w_{k}") * v for k, v in signals.items()), F.lit(0.0))
    return j.withColumn("score", score).select(*facts.columns, "score")


def mmr_rerank(rows: DataFrame, penalty: float = -0.2) -> DataFrame:
    """query_id, vec_id, place, mmr_score: repeatedly the row of greatest score plus penalty times its largest cosine to
    those chosen (ties: the better score, then the smaller id); all rows of every query.

    rows: query_id, vec_id, score, v. A group is one query's list of results, which the step before it has cut to a top k.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(pdf["v"].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        near, score, order, got = np.zeros(len(x)), pdf["score"].to_numpy(float), [], []
        open_ = np.ones(len(x), bool)
        for _ in range(len(x)):
            value = np.where(open_, score + penalty * near, -np.inf)
            i = int(value.argmax())  # the first of equals
            order.append(i)
            got.append(value[i])
            open_[i] = False
            near = np.maximum(near, x @ x[i])
        out = pdf.loc[order, ["query_id", "vec_id"]]
        return out.assign(place=np.arange(1, len(order) + 1), mmr_score=got)

    kinds = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, place long, mmr_score double")


def dynamic_selection(rows: DataFrame, by: str, order: str, share: float = 0.6, least: int = 2, most: int = 20) -> DataFrame:
    """Rows of score >= share * the group's best; at least `least`, at most `most`."""
    top = F.max("score").over(Window.partitionBy(by))
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order)).cast("long")
    r = rows.withColumn("place", at).withColumn("top", top)
    return r.where((F.col("place") <= most) & ((F.col("score") >= F.col("top") * share) | (F.col("place") <= least))).drop("top")


def answer_confidence(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """topic, confidence from chunks (topic, quality, trust, source_url) and facts (topic, place, sentence), which are found once."""
    facts = stage(facts.select("topic", "place", "sentence"), "confidence-facts")
    c = chunks.groupBy("topic").agg(F.avg("quality").alias("q"), F.avg("trust").alias("t"), F.count_distinct("source_url").alias("n"))
    w = facts.where("place <= 10").select("topic", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\w{4,}"), F.lit(0))).alias("w"))
    use = w.groupBy("topic", "w").agg(F.count(F.lit(1)).alias("k"))
    top = use.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("k"), "w"))).where("r <= 5")
    often = top.groupBy("topic").agg(F.count(F.when(F.col("k") >= 3, 1)).alias("often"))
    n = facts.groupBy("topic").agg(F.count(F.lit(1)).alias("facts"))
    j = c.join(often, "topic", "left").join(n, "topic", "left")
    same = F.when(F.coalesce("facts", F.lit(0)) < 3, 0.5).when(F.coalesce("often", F.lit(0)) == 0, 0.4).otherwise(F.least(F.col("often") / 3, F.lit(1.0)))
    total = F.col("q") * 0.3 + F.col("t") * 0.25 + F.least(F.col("n") / 5, F.lit(1.0)) * 0.2 + same * 0.15
    return j.select("topic", F.least(F.when(F.col("n") == 1, total * 0.8).when(F.col("n") == 0, total * 0.5).otherwise(total), F.lit(1.0)).alias("confidence"))


def best_chunk(chunks: DataFrame) -> DataFrame:
    """topic, chunk_id, quality: the best chunk of each topic (ties by the first id)."""
    b = chunks.groupBy("topic").agg(F.min(F.struct((-F.col("quality")).alias("q"), "chunk_id")).alias("x"))
    return b.select("topic", "x.chunk_id", (-F.col("x.q")).alias("quality"))


def answer_queries(queries: DataFrame, pairs: DataFrame, chunks: DataFrame, n: int = 20, encoder=None, similar: float = 0.85, most_chunks: int = 50, unasked: tuple[str, ...] = (), patterns: dict[str, str] = PROFILE_PATTERNS, profile: str | None = None, keywords: list[str] | None = None, **rules) -> DataFrame:
    """query_id, place, sentence, score, profile, confidence: what the documents paired with each query say about it.

    queries: query_id, query; pairs: query_id, doc_id; chunks: doc_id, idx, source_url, text. A document's chunks pass the gate
    (quality 0.5, the first most_chunks of each document), and its sentences are found once, however many queries ask for it. For
    each query, chunks and sentences that begin alike are taken once, sentences are scored by the query's words, and the 50
    best stay; of those, what is like a better one (cosine over `similar`) goes, and the rest are ranked by the query's profile
    (see profile_of), reranked and selected. Relevance is the cosine to the query's vector, position the share of the
    chunk before the sentence, ner the number of capitalised words after its first. Queries without a sentence have no
    rows. encoder: a function of texts to vectors (see embed_corpus); unasked: words of a query that are no
    keywords; profile and keywords: the same for all queries; rules: of drop_reason.
    """
    encoder = encoder or hashed_words(64)
    split = F.array_distinct(F.split(F.lower("query"), r"[^\p{L}\p{N}_]+"))
    own = F.filter(split, lambda w: (F.length(w) > 2) & ~w.isin(*unasked)) if keywords is None else F.array(*(F.lit(k.lower()) for k in keywords))
    kind = profile_of(F.col("query"), patterns) if profile is None else F.lit(profile)
    asked = stage(queries.select("query_id", "query", own.alias("keywords"), kind.alias("profile")), "asked")
    wanted = stage(embed_corpus(asked, "query_id", "query", encoder).withColumnRenamed("embedding", "wanted"), "query-vectors")
    pairs = stage(pairs.select("query_id", "doc_id").distinct(), "pairs")
    mine = sized_join(chunks.select("doc_id", "idx", "source_url", "text"), stage(pairs.select("doc_id").distinct(), "asked-docs"), ["doc_id"])
    gated = stage(chunk_quality_gate(mine, most=most_chunks).withColumn("trust", domain_credit(host(F.col("source_url")))), "gated")
    heads = pairs.join(gated.select("doc_id", "idx", "source_url", "quality_score", "trust", F.substring("text", 1, 200).alias("head")), "doc_id")
    kept = stage(first_by_prefix(heads, "head", ["query_id"], ["doc_id", "idx"], 200, False).drop("head"), "kept-chunks")
    said = stage(fact_candidates(gated.withColumn("topic", F.col("idx")), **rules).withColumnRenamed("topic", "idx"), "said")
    facts = kept.select("query_id", "doc_id", "idx").join(said, ["doc_id", "idx"])
    facts = first_by_prefix(facts, "sentence", ["query_id"], ["doc_id", "idx", "pos"], 100)
    known = sized_join(facts, asked.drop("query"), ["query_id"])
    scored = score_facts(known, F.col("keywords"), F.col("pos") / F.col("of"))
    top = best_per(scored, "query_id", [F.desc(F.round("total_score", 6)), F.col("doc_id"), F.col("idx"), F.col("pos")], 50)
    number = F.shiftleft(F.pmod(F.xxhash64("query_id"), F.lit(1 << 40)), 6) + F.col("place")  # ascends by place within a query
    top = stage(top.withColumn("id", number), "facts")
    top = stage(top.join(embed_corpus(top, "id", "sentence", encoder), "id"), "facts")
    links = cosine_links(top.select(F.col("id").alias("vec_id"), "embedding", "query_id"), similar, "query_id", strict=True)
    alone = semantic_dedup(top.select("id"), links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).where("kept").select("id")
    named = F.size(F.filter(F.slice(words(F.col("sentence")), 2, 10_000), lambda x: F.left(x, F.lit(1)) != F.lower(F.left(x, F.lit(1)))))
    rated = sized_join(top.join(alone, "id").drop("place"), wanted, ["query_id"])
    rated = rated.withColumns({"relevance": F.greatest(dot(F.col("embedding"), F.col("wanted")), F.lit(0.0)), "credit": domain_credit(host(F.col("source_url"))), "position": F.col("pos") / F.col("of"), "ner": named})
    ranked = stage(rank_facts(rated).withColumn("score", F.round("score", 6)), "ranked")
    order = mmr_rerank(ranked.select("query_id", F.col("id").alias("vec_id"), "score", F.col("embedding").alias("v")))
    again = order.select(F.col("vec_id").alias("id"), F.col("place").alias("key"), F.round("mmr_score", 6).alias("mmr"))
    chosen = stage(dynamic_selection(ranked.join(again, "id").drop("score").withColumnRenamed("mmr", "score"), "query_id", "key", 0.6, 2, n), "chosen")
    sure = answer_confidence(kept.select(F.col("query_id").alias("topic"), F.col("quality_score").alias("quality"), "trust", "source_url"), chosen.select(F.col("query_id").alias("topic"), "place", "sentence"))
    return sized_join(chosen, stage(sure.withColumnRenamed("topic", "query_id"), "confidence"), ["query_id"]).select("query_id", "place", "sentence", "score", "profile", "confidence")


def fact_pipeline(chunks: DataFrame, keywords: list[str], profile: str = "default", n: int = 20, encoder=None, similar: float = 0.85, **rules) -> DataFrame:
    """topic, place, sentence, score, profile, confidence: answer_queries for each topic of chunks (doc_id, topic, source_url,
    text), asked with the same keywords; every row is a document of one chunk."""
    rows = chunks.withColumn("idx", F.lit(0))
    queries = chunks.select(F.col("topic").alias("query_id"), F.lit(" ".join(keywords)).alias("query")).distinct()
    found = answer_queries(queries, chunks.select(F.col("topic").alias("query_id"), "doc_id"), rows, n, encoder, similar, profile=profile, keywords=keywords, **rules)
    return found.withColumnRenamed("query_id", "topic")
