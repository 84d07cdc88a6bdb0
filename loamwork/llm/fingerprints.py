"""Document fingerprints by consistent weighted sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import stage

PLACES = 128
TOGETHER = 16
BLANK = r"[\x20\x09-\x0D]+"


def sample_value(term: str, place: str, log_weight: str, reach: str) -> Column:
    """log of the sampled hash value of a weighted term in a place; the term with the least one is the place's sample.

    Consistent weighted sampling with gamma variables: r and c ~ Gamma(2, 1) and beta ~ U(0, 1) are functions of term
    and place alone. t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r. Two weights that give one t give one
    a, so samples collide as often as the generalised Jaccard similarity says. c = -ln p and r = -ln e, where p and e
    are products of two uniforms each, quarters of one hash.

    Null where (1 - p) e > reach: as t - beta <= ln w / r and c >= 1 - p, a is at least (1 - p) e / w, so with
    reach = m w no a up to m is left out, and most terms of a long text take no logarithm. Names are SQL.
    """
    quarter = lambda shift: f"((shiftrightunsigned(xxhash64({term}, {place}), {shift}) & 65535L) + 0.5D)"
    p, e = f"{quarter(48)} * {quarter(32)} * {2.0**-32!r}D", f"{quarter(16)} * {quarter(0)} * {2.0**-32!r}D"
    beta = f"(shiftrightunsigned(xxhash64({term}, {place}, 1), 32) + 0.5D) * {2.0**-32!r}D"
    return F.expr(f"CASE WHEN (1 - {p}) * {e} <= {reach} THEN ln(-ln({p})) + ln({e}) * (floor({log_weight} / -ln({e}) + {beta}) - {beta} + 1) END")


def likeness(x: Column, y: Column) -> Column:
    """Share of the places in which both fingerprints hold one sample; 1 for two empty ones."""
    none = (F.size(x) == 0) & (F.size(y) == 0)
    return F.when(none, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.lit(PLACES))


def fingerprint_text(x: Column) -> Column:
    """The places in order: two hex digits for the place and four for its sample."""
    return F.array_join(F.transform(x, lambda e: F.lpad(F.lower(F.hex(e)), 6, "0")), "")


NO_ID = -(2**63)


def numbered(docs: DataFrame) -> DataFrame:
    """text (null is empty), oid (doc_id, the least long for null) and tie (a hash of the text) of docs."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("oid"), F.xxhash64(text).alias("tie"))


def with_ranges(docs: DataFrame, rows_per_range: int = 500, most: int = 100_000) -> DataFrame:
    """docs (doc_id, text) in ranges of ascending doc_id, for windows: b, ghost, oid, text, tie.

    Range limits are approximate quantiles, at most `most`. The first rows of each range are repeated as ghosts at the
    end of the range before it (of the last range, for the first), so the next row is at hand in every range. oid is
    doc_id with the least long for null. Rows are dealt to a task for every two ranges.
    """
    rows = numbered(docs)
    n = max(1, min(most, docs.count() // rows_per_range))
    cuts = rows.agg(F.percentile_approx("oid", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    splits = sorted({float(x) for x in cuts or []} - {float("-inf")})
    marks = [float("-inf"), *splits, float("inf")]
    ranged = Bucketizer(splits=marks, inputCol="_at", outputCol="_b").transform(rows.withColumn("_at", F.col("oid").cast("double"))) if splits else rows.withColumn("_b", F.lit(0.0))
    ranged = ranged.select("text", "oid", "tie", F.col("_b").cast("int").alias("b"))
    firsts = ranged.groupBy("b").agg(F.min("oid").alias("oid"))
    order, all_ = Window.orderBy("b"), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("b", "oid", F.coalesce(F.lag("b").over(order), F.last("b").over(all_)).alias("before"))  # a row for each range
    joined = ranged.join(F.broadcast(firsts), ["b", "oid"], "left")
    own = F.struct(F.col("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("before").alias("b"), F.lit(True).alias("ghost"))
    places = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ghost)))
    out = joined.select("text", "oid", "tie", places.alias("p")).select("p.b", "p.ghost", "oid", "text", "tie")
    return out.repartition(max(n // 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "b")


def samples(texts: DataFrame, keys: list[str], theta: float | None) -> DataFrame:
    """keys, at, c: the samples (16 bits) of the places at, at + 1, ... of every text (column t) that has words.

    A term is a word; its weight is the number of the text's characters that it covers. Every term is sampled in each of
    the PLACES places: it becomes a row for every TOGETHER places, which are aggregates of their own, so only one value
    for each place and text outlives the task's first pass. With theta, terms that can't have a value up to theta over
    the text's whole weight are not worked out, and a place whose least value is not below that is null.
    """
    total = F.length(F.regexp_replace("t", BLANK, "")).cast("double").alias("total")
    words = texts.select(*keys, "t", total).select(*keys, "total", F.explode(F.split("t", BLANK)).alias("word"))
    terms = words.groupBy(*keys, "total", F.xxhash64("word").alias("term")).agg(F.sum(F.length("word")).cast("double").alias("w")).where("w > 0")
    reach = F.lit(4.0) if theta is None else F.lit(theta) * F.col("w") / F.col("total")  # (1 - p) e is below 1
    starts = F.explode(F.array(*map(F.lit, range(0, PLACES, TOGETHER))))
    many = terms.select(*keys, "total", "term", F.ln("w").alias("log"), reach.alias("reach"), starts.alias("at"))
    least = many.groupBy(*keys, "total", "at").agg(*(F.min(sample_value("term", f"at + {i}", "log", "reach")).alias(f"a{i}") for i in range(TOGETHER)))
    proven = "true" if theta is None else f"a{{0}} < ln({theta!r}D / total) - 1e-9D"
    code = lambda i: F.expr(f"CASE WHEN {proven.format(i)} THEN smallint((xxhash64(a{i}) & 65535) - 32768) END")
    return least.select(*keys, "at", F.array(*map(code, range(TOGETHER))).alias("c"))


def with_texts(want: DataFrame, docs: DataFrame) -> DataFrame:
    """b, seq, v, t of want (b, seq, v, oid, tie, noid, ntie; few rows): the texts are fetched by id and hash, not dealt again."""
    need = want.select("oid", "tie").unionByName(want.where("noid IS NOT NULL").select(F.col("noid").alias("oid"), F.col("ntie").alias("tie")))
    got = sized_join(numbered(docs), stage(need.distinct(), "needed"), ["oid", "tie"]).dropDuplicates(["oid", "tie"])
    got = stage(got.select("oid", "tie", "text"), "texts")
    both = want.join(got, ["oid", "tie"]).join(got.select(F.col("oid").alias("noid"), F.col("tie").alias("ntie"), F.col("text").alias("next")), ["noid", "ntie"], "left")
    t = F.when(F.col("v") == 0, F.col("text")).otherwise(edited(F.col("text"), F.coalesce("next", F.lit(""))))
    return both.select("b", "seq", "v", t.alias("t"))


def edited(text: Column, after: Column) -> Column:
    """text with its last half of code points replaced by the first as many of the text after it."""
    half = F.call_function("div", F.length(text), F.lit(2)).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, theta: float = 10.0) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the text with its last n_chars div 2 code points replaced by the first as many of the next
    document by ascending doc_id (null first; after the last, the first; equal ids by a hash of the text). A null text
    is empty, and the likeness of two texts without words is 1. A document alone is its own next. The texts are
    shuffled once, into ranges of doc_id, where samples and all facts are taken in one job. The least value of a place
    is over theta / weight with probability exp(-theta); the few texts with such a place are sampled again in full.
    """
    w = Window.partitionBy("b").orderBy("ghost", "oid", "tie")
    rows = with_ranges(docs)  # one exchange, whose columns both branches below read
    rows = rows.select("b", F.row_number().over(w).alias("seq"), "ghost", "oid", "tie", "text", edited(F.col("text"), F.coalesce(F.lead("text").over(w), F.lit(""))).alias("edited"))
    both = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("v"), F.col(c).alias("t")) for i, c in enumerate(("text", "edited")))))
    sampled = samples(rows.select("b", "seq", both.alias("x")).select("b", "seq", "x.*"), ["b", "seq", "v"], theta)
    facts = rows.select("b", "seq", "ghost", "oid", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    first = stage(sampled.unionByName(facts, allowMissingColumns=True), "samples")
    own = Window.partitionBy("b").orderBy("seq")
    facts = first.where("at IS NULL").select("b", "seq", "ghost", "oid", "tie", "n_chars", "edited_sha256")
    sampled = first.where("at IS NOT NULL").select("b", "seq", "v", "at", "c")
    rest = stage(sampled.where(F.exists("c", lambda x: x.isNull())).select("b", "seq", "v").distinct(), "open")
    nexts = facts.select("b", "seq", "oid", "tie", F.lead("oid").over(own).alias("noid"), F.lead("tie").over(own).alias("ntie"))
    want = stage(sized_join(nexts, rest, ["b", "seq"]), "want")
    whole = sized_join(sampled, rest, ["b", "seq", "v"], "left_anti").unionByName(samples(with_texts(want, docs), ["b", "seq", "v"], None))
    coded = F.transform("c", lambda x, i: F.shiftleft(F.col("at") + i, 16) + x.cast("int") + 32768)
    found = whole.select("b", "seq", "v", coded.alias("c")).groupBy("b", "seq").agg(*(F.sort_array(F.flatten(F.collect_list(F.when(F.col("v") == i, F.col("c"))))).alias(c) for i, c in enumerate(("p", "e"))))
    none = F.array().cast("array<int>")
    out = facts.join(found, ["b", "seq"], "left").withColumns({"p": F.coalesce("p", none), "e": F.coalesce("e", none)})
    out = out.withColumn("q", F.lead("p").over(own)).where("NOT ghost")
    p, e, q = F.col("p"), F.col("e"), F.col("q")
    doc_id = F.when(F.col("oid") != NO_ID, F.col("oid"))
    return out.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", fingerprint_text(p).alias("fingerprint"), fingerprint_text(e).alias("edited_fingerprint"), likeness(p, e).alias("near_edited"), likeness(p, q).alias("near_next"))
