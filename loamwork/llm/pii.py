"""Personal data by candidate spans and gradient-boosted trees (DataFrame functions and JVM-side ML only)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import stage

KINDS = ("email", "ip", "card", "phone")

#: What each base kind looks like. Possessive loops and the look-behinds change no match; they keep the
#: search linear and off the stack in long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: addresses written out, and numbers with any mixture of separators.
WIDE = {
    "at": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = 24


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)
    at = lambda i: F.coalesce(F.substring(back, i, F.lit(1)).try_cast("int"), F.lit(0))
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, at(i)).otherwise(twice(at(i))))
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of its spans."""
    d = digits(value)
    small = F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(x, F.lit(3)).try_cast("int") <= 255))
    card = F.length(d).between(13, 19)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", F.when(card, luhn(d)).otherwise(False)).when(kind == "phone", F.length(d).between(9, 15)).otherwise(False)


def sound(kind: Column, value: Column) -> Column:
    """Whether a value, however it is written, can be one of the kind: its digits pass the kind's checks, an address ends in letters."""
    plain = F.when(kind == "ip", F.regexp_replace(value, "[^0-9.]", "")).otherwise(value)
    return F.coalesce(valid(kind, plain) & ((kind != "email") | value.rlike("[A-Za-z]{2}$")), F.lit(False))


def proposed(pattern: Column, value: Column) -> Column:
    """The kinds that a match of a pattern may be of."""
    d = F.length(digits(value))
    dots = F.length(value) - F.length(F.replace(value, F.lit("."), F.lit("")))
    wide = F.filter(F.array(F.when(d.between(9, 15), "phone"), F.when(d.between(12, 19), "card"), F.when((dots == 3) & (d <= 12), "ip")), lambda x: x.isNotNull())
    return F.when(pattern == "at", F.array(F.lit("email"))).when(pattern == "number", wide).otherwise(F.array(pattern))


def rewritten(kind: Column, value: Column, draw: Column) -> Column:
    """A base span as people write it to hide it or by habit; draw (a long) chooses the form. Not all are matches of WIDE."""
    user, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    at = pick([" (at) ", "(at)", " [at] ", "[at]", " @ "], draw)
    dot = pick([" (dot) ", "(dot)", " [dot] ", "[dot]", "."], F.shiftright(draw, 8))
    d, bare = digits(value), F.replace(value, F.lit("+"), F.lit(""))
    runs = [F.regexp_replace(bare, "[^0-9]+", x) for x in (".", "-", " ", "")]
    phone = pick([bare, F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]+", ""), *runs], draw)
    fours = [F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{x}") for x in (".", ". ", "--", "  ")]
    mixed = F.regexp_replace(d, "^([0-9]{4})([0-9]{4})([0-9]{4})", "$1.$2-$3 ")
    ip = pick([F.replace(value, F.lit("."), F.lit(x)) for x in (". ", " .")], draw)
    return F.when(kind == "email", F.concat(user, at, F.replace(host, F.lit("."), dot))).when(kind == "phone", phone).when(kind == "card", pick([*fours, mixed], draw)).otherwise(ip)


#: Words before numbers that are no personal data, words before phone numbers, and words that say nothing.
NUMBER_WORDS = r"\b(?:doi|is[bs]n|serial|pages?|pp|version|release|build|order|invoice|total|sum|ref|no|number|id|lat|long?|coordinates|model|part|seiten?|summe|nummer)[.:#]?\x20?(?:10)?$"
PHONE_WORDS = r"\b(?:phone|tel|telephone|call|call me at|call me on|fax|mobile|cell|ring|telefon|anruf)[.:]?\x20?$"
PLAIN_WORDS = ("the", "of", "and", "with", "see", "by", "then")
AFTER = (" and", ". The", ", which", " of", " call", " for")


def pick(forms: Sequence, by: Column) -> Column:
    """One of the forms, by a long."""
    return F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in forms)), (F.pmod(by, F.lit(len(forms))) + 1).cast("int"))


def isbn10(nine: Column) -> Column:
    """The check digit of nine digits (10 where X would stand)."""
    at = lambda i: F.coalesce(F.substring(nine, i, F.lit(1)).try_cast("int"), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda s, i: s + i * at(i)) % 11


def ordinary(draw: Column) -> tuple[Column, Column]:
    """Word and value of a number that is no personal data: DOIs, ISBNs, serials, orders, pages, versions, coordinates, sums, dates."""
    by = lambda i: F.shiftright(F.xxhash64(F.lit(i), draw), 8)
    num = lambda i, n: F.lpad(F.pmod(by(i), F.lit(10**n)).cast("string"), n, "0")
    upto = lambda i, low, n: F.pmod(by(i), F.lit(n)) + low
    sep, blank = pick(["-", " "], by(1)), pick([" ", "."], by(2))
    nine = num(3, 9)
    check = isbn10(nine)
    last = F.when(check == 10, 0).otherwise(check).cast("string")
    cut = pick(["^(.)(...)(.*)$", "^(.)(..)(.*)$", "^(.)(....)(.*)$"], by(4))
    book = F.concat(F.regexp_replace(nine, cut, F.concat(F.lit("$1"), sep, F.lit("$2"), sep, F.lit("$3"))), sep, last)
    doi = F.concat(F.lit("10."), num(5, 4), F.lit("."), pick([num(6, 9), num(6, 6), F.concat(num(7, 4), F.lit("."), num(8, 3))], by(9)))
    serial = pick([F.lpad(num(10, 3), 10, "0"), F.concat(F.lit("000"), num(11, 7)), num(12, 10), num(12, 11), num(12, 12)], by(13))
    first = upto(14, 10, 290)
    second = first + upto(15, 1, 400)
    third = second + upto(16, 1, 400)
    pages = F.replace(F.concat_ws(" ", first, second, third, third + upto(18, 1, 400)), F.lit(" "), pick(["-", "-", ". ", " "], by(17)))
    version = F.concat_ws(".", upto(19, 1, 20), upto(20, 0, 12), num(21, 5), num(22, 4))
    grid = pick([4, 5, 6], by(23))
    place = F.concat(num(24, 2), F.lit("."), F.left(num(25, 6), grid), F.lit(" "), num(26, 2), F.lit("."), F.left(num(27, 6), grid))
    total = F.replace(F.concat_ws(" ", upto(28, 1, 999), num(29, 3), num(30, 3), pick([num(31, 3), F.lit("000")], by(32))), F.lit(" "), blank)
    day = lambda i: F.concat_ws("-", upto(i, 1950, 90), F.lpad(upto(i + 1, 1, 12).cast("string"), 2, "0"), F.lpad(upto(i + 2, 1, 28).cast("string"), 2, "0"))
    clock = F.concat_ws(".", *(F.lpad(upto(i, 0, n).cast("string"), 2, "0") for i, n in ((40, 24), (41, 60), (42, 60))))
    date = pick([F.concat_ws(" ", day(43), day(46)), F.concat_ws(" ", day(43), clock), F.concat(F.replace(day(43), F.lit("-"), F.lit("")), F.replace(clock, F.lit("."), F.lit("")))], by(49))
    kinds = [("doi", doi), ("isbn", book), ("isbn", F.concat(F.lit("978"), sep, book)), ("serial", serial), ("order", serial), ("pages", pages), ("version", version), ("coordinates", place), ("total", total), ("on", date)]
    return pick([w for w, _ in kinds], draw), pick([v for _, v in kinds], draw)


def matches(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pattern, start, end, value, before, after: all leftmost non-overlapping matches of all patterns.

    start and end count code points. A match begins after the matches and the gaps before it, so its place is a running
    sum over the rows of its text and pattern; a text of very many matches is only many rows. keys identify texts;
    rows with equal keys count once.
    """
    tried = []
    for name, pattern in (BASE | WIDE).items():
        hint = F.contains("text", F.lit(NEEDS[name])) if name in NEEDS else F.col("text").rlike("@|at[)\\]]" if name == "at" else "[0-9]")
        some = hint & F.col("text").rlike(pattern)
        tried.append(F.struct(F.lit(name).alias("pattern"), F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"), F.when(some, F.split("text", pattern, -1)).alias("p")))
    cut = docs.select(*keys, F.explode(F.array(*tried)).alias("x")).select(*keys, "x.*").where("m IS NOT NULL")  # the texts are read once
    rows = cut.select(*keys, "pattern", F.posexplode(F.arrays_zip("m", F.slice("p", F.lit(1), F.size("m")).alias("g"), F.slice("p", F.lit(2), F.size("m")).alias("n"))).alias("i", "x"))
    found = rows.select(*keys, "pattern", "i", F.length("x.g").alias("gap"), F.col("x.m").alias("value"), F.right("x.g", F.lit(CONTEXT)).alias("before"), F.left("x.n", F.lit(CONTEXT)).alias("after"))
    every = found.dropDuplicates([*keys, "pattern", "i"])
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy(*keys, "pattern").orderBy("i"))
    return every.withColumn("end", end).select(*keys, "pattern", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after")


def candidates(found: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping proposals: keys, kind, start, end, value, before, after, base (a valid match of the kind's own pattern).

    A match proposes its own kind; a wide number proposes every kind whose count of digits it has, a written address an
    email. Proposals of one span and kind are one.
    """
    own = found.select("*", F.explode(proposed(F.col("pattern"), F.col("value"))).alias("kind"))
    own = own.withColumn("base", (F.col("pattern") == F.col("kind")) & valid(F.col("kind"), F.col("value")))
    return own.groupBy(*keys, "kind", "start", "end").agg(F.max("value").alias("value"), F.max("before").alias("before"), F.max("after").alias("after"), F.max("base").alias("base"))


def features(c: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of each candidate as numbers, without what the base patterns and `sound` ask for themselves."""
    v, near = F.col("value"), F.lower(F.concat_ws(" ", "before", "after"))
    has = lambda x: F.contains(v, F.lit(x)).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    d, before = digits(v), F.lower("before")
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    values = F.transform(groups, lambda g: g.try_cast("long"))
    size = lambda i: F.coalesce(F.length(F.get(groups, F.lit(i))), F.lit(0)).cast("double")
    book = F.length(d).isin(10, 13) & (isbn10(F.left(F.right(d, F.lit(10)), F.lit(9))) == F.right(d, F.lit(1)).try_cast("int"))
    edge = lambda x: F.coalesce(x.rlike("[A-Za-z0-9]").cast("double"), F.lit(0.0))
    out = {
        **{f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS},
        "length": F.length(v).cast("double"),
        "letters": count("[A-Za-z]"),
        "blanks": count(r"\x20"),
        "dashes": has("-"),
        "dots": count(r"\."),
        "brackets": count("[()]"),
        "groups": F.size(groups).cast("double"),
        "widest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "first": F.coalesce(F.left(d, F.lit(1)).try_cast("double"), F.lit(-1.0)),
        "digits": F.length(d).cast("double"),
        **{f"group_{i}": size(i) for i in range(4)},
        "zeros": F.length(F.regexp_extract(d, "^(0*)", 1)).cast("double"),
        "different": F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        "rising": ((F.size(groups) > 2) & (F.array_sort(values) == values)).cast("double"),
        "of_ten": v.startswith("10.").cast("double"),
        "book": book.cast("double"),
        "year": F.coalesce(F.get(values, F.lit(0)).between(1900, 2099).cast("double"), F.lit(0.0)),
        "ending": F.length(F.regexp_extract(v, "([A-Za-z]*)$", 1)).cast("double"),
        "glued_before": edge(F.right("before", F.lit(1))),
        "glued_after": edge(F.left("after", F.lit(1))),
        "mark_after": F.left("after", F.lit(1)).rlike("[.,;:!?]").cast("double"),
        "says_mail": near.rlike("mail|contact").cast("double"),
        "says_phone": near.rlike("phone|tel|call|fax|mobile").cast("double"),
        "says_card": near.rlike("card|visa|payment|credit").cast("double"),
        "says_ip": near.rlike("ip|address|host|server").cast("double"),
        "names_number": before.rlike(NUMBER_WORDS).cast("double"),
        "names_phone": before.rlike(PHONE_WORDS).cast("double"),
        "says_version": near.rlike("version|v\\.|release|isbn|issn|doi").cast("double"),
    }
    return c.withColumns({f"f_{k}": F.coalesce(x, F.lit(0.0)) for k, x in out.items()}), [f"f_{k}" for k in out]


class PiiModel:
    """Boosted trees over candidates and, for each kind, the score that a span must reach. Without trees nothing is added."""

    def __init__(self, trees: GBTClassificationModel | None, limits: dict[str, float]):
        self.trees, self.limits = trees, limits

    def scored(self, c: DataFrame) -> DataFrame:
        if self.trees is None:
            return c.withColumn("score", F.lit(0.0))
        rows, names = features(c)
        joined = VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
        return self.trees.transform(joined).withColumn("score", vector_to_array("probability")[1]).select(*c.columns, "score")

    def limit(self) -> Column:
        return reduce(lambda e, k: F.when(F.col("kind") == k, F.lit(self.limits[k])).otherwise(e), self.limits, F.lit(2.0))


def taught(c: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (of staged ones) with label and sure, none of them a base span, all sound.

    Each base span is rewritten into a form that only the wide generators match: positive as its own kind, negative as
    any other that it proposes and if letters are glued to it. Phones are written in national groups too, where they
    stand and after a word that names them. Beside each base span stand ordinary numbers (see ordinary), negative as all
    that they propose, after the word that names them or one that says nothing. Candidates that overlap no base span are
    negative too, but sure only if they are glued: the others may be personal data that no rule has named.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    marked = c.withColumn("clear", (F.coalesce(ends, F.lit(0)) <= F.col("start")) & (F.coalesce(starts, F.col("end")) >= F.col("end")))
    glued = F.coalesce(F.right("before", F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False)) | F.coalesce(F.left("after", F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False))
    free = marked.where("clear AND NOT base").withColumns({"label": F.lit(0.0), "sure": glued})
    many = lambda n: c.where("base").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draw = F.shiftright(F.xxhash64(F.lit(7), "value", "start", "n", *keys), 8)
    base = many(3)
    new = base.withColumn("value", rewritten(F.col("kind"), F.col("value"), draw))
    whole = reduce(lambda e, k: F.when(F.col("value").rlike(f"^(?:{WIDE[k]})$"), k).otherwise(e), WIDE, F.lit(None).cast("string"))
    by = lambda i: F.shiftright(F.xxhash64(F.lit(i), draw), 8)
    own = F.right(digits(F.col("value")), F.lit(10))
    mark = pick([" ", " ", "-", "."], by(52))
    zero = F.concat(F.lit("0"), F.substring(own, 2, 9))
    cut = lambda d, group: F.regexp_replace(d, group, F.concat(F.lit("$1"), mark, F.lit("$2"), mark, F.lit("$3")))
    threes = cut(own, "^(...)(...)(....)$")
    grouped = pick([threes, F.regexp_replace(own, "^(...)(...)(....)$", "($1) $2-$3"), cut(own, "^(..)(....)(....)$"), cut(zero, "^(...)(....)(...)$"), cut(zero, "^(....)(...)(...)$"), threes], by(51))
    named = pick(["phone ", "call ", "tel ", "call me at ", "mobile: ", "telephone ", "fax ", "ring "], by(54))
    phones = base.where("kind = 'phone'")
    new = new.unionByName(phones.withColumn("value", grouped))
    new = new.unionByName(phones.withColumns({"value": pick([grouped, own], by(53)), "before": named, "after": pick(AFTER, by(55))}))
    new = new.withColumn("pattern", whole).where("pattern IS NOT NULL").withColumn("as", F.explode(proposed(F.col("pattern"), F.col("value"))))
    new = new.withColumn("glue", F.explode(F.array(F.lit(""), F.lit("c"))))
    new = new.withColumns({"label": ((F.col("kind") == F.col("as")) & (F.col("glue") == "")).cast("double"), "sure": F.lit(True)})
    new = new.withColumns({"kind": F.col("as"), "before": F.concat("before", "glue"), "after": F.concat("glue", "after")})
    seed = F.shiftright(F.xxhash64(F.lit(8), "value", "start", "n", *keys), 8)
    word, value = ordinary(seed)
    said = F.when(F.pmod(F.shiftright(seed, 10), F.lit(4)) > 0, word).otherwise(pick(PLAIN_WORDS, F.shiftright(seed, 16)))
    other = many(6).withColumns({"value": value, "before": F.concat(F.lit(" "), said, F.lit(" ")), "after": pick(AFTER, F.shiftright(seed, 12))})
    other = other.withColumn("kind", F.explode(proposed(F.lit("number"), F.col("value")))).withColumns({"label": F.lit(0.0), "sure": F.lit(True)})
    columns = [*c.columns, "label", "sure"]
    return free.select(columns).unionByName(new.select(columns)).unionByName(other.select(columns)).where(sound(F.col("kind"), F.col("value")))


def train(c: DataFrame, keys: list[str], rounds: int = 16, precision: float = 0.98) -> PiiModel:
    """Trees and limits from all staged candidates.

    There are no labelled spans, so rewritten base spans and ordinary numbers teach (see taught): what is added must look
    like a base span in another form, and the base rule itself cannot be learned. Negatives weigh as much as the positives of their
    kind at most, those that are not sure half of that, and a leaf has ten rows at least, so a few hidden spans do not unteach the trees. The
    candidates of a fifth of the texts, by a hash of their keys, are kept from the trees and set each kind's limit: the least score, 0.5 at
    least, over which `precision` of the weight of sure candidates is positive; a kind without such a score adds nothing.
    """
    rows, names = features(stage(taught(c, keys), "pii-taught"))
    part = F.pmod(F.xxhash64(F.lit(6), *keys), F.lit(5))
    rows = VectorAssembler(inputCols=names, outputCol="_x").transform(rows).select("kind", "label", "sure", part.alias("part"), "_x")
    known = stage(rows, "pii-features")  # the trees read them several times
    fit, check = known.where("part <> 0"), known.where("part = 0")
    of = lambda c: F.sum(c.cast("long"))
    bad = (F.col("label") == 0) & F.col("sure")
    counts = {r.kind: r for r in fit.groupBy("kind").agg(F.sum("label").alias("good"), of(bad).alias("bad"), of(~F.col("sure")).alias("open")).collect()}
    if not any(r.good for r in counts.values()) or check.isEmpty():
        return PiiModel(None, {})
    share = lambda most, field: reduce(lambda e, k: F.when(F.col("kind") == k, min(1.0, most * counts[k].good / max(1, counts[k][field]))).otherwise(e), counts, F.lit(1.0))
    weight = F.when(bad, share(1.0, "bad")).when(F.col("sure"), 1.0).otherwise(0.5 * F.least(share(1.0, "bad"), share(1.0, "open")))
    rows = fit.withColumn("weight", weight).where("weight > 0").select("_x", "label", "weight")
    trees = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.3, minInstancesPerNode=10, seed=1, cacheNodeIds=False).fit(rows)
    model = PiiModel(trees, {})
    score = F.round(vector_to_array("probability")[1], 2)
    judged = trees.transform(check.where("sure").withColumn("weight", weight)).groupBy("kind", score.alias("s")).agg(F.sum("label").alias("good"), F.sum("weight").alias("n"))
    table = sorted(judged.collect(), key=lambda r: -r.s)  # a hundred scores for each kind at most
    for kind in KINDS:
        mine = [r for r in table if r.kind == kind]
        good = total = 0
        for r, low in zip(mine, [*(x.s for x in mine[1:]), 0.0], strict=False):
            good, total = good + r.good, total + r.n
            if r.s >= 0.5 and good >= precision * total:
                model.limits[kind] = max(0.5, low + 0.005)
    return model


def find_spans(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """doc_id, tie, kind, start, end, base: the spans of each text of docs (doc_id, text, tie).

    All base spans, and the sound candidates that reach their kind's limit, overlap no base span and no added span before
    them. Without a model, one is trained on the candidates themselves.
    """
    keys = ["doc_id", "tie"]
    c = stage(candidates(matches(docs, keys), keys), "pii")
    model = model or train(c, keys)
    base = c.where("base").select(*keys, "kind", "start", "end", "base")
    if not model.limits:
        return base
    more = model.scored(c.where("NOT base").where(sound(F.col("kind"), F.col("value")))).where(F.col("score") >= model.limit()).select(*keys, "kind", "start", "end", "base", "score")
    both = base.withColumn("score", F.lit(1.0)).unionByName(more)
    # an added span is free if no span before it ends after its start and no base span begins before its end
    w = Window.partitionBy(*keys).orderBy("start", F.desc("base"), F.desc("score"), "end", "kind")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return both.withColumn("free", free).where("base OR free").select(*keys, "kind", "start", "end", "base")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))


def pii_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document (see find_spans).

    The counts and the digest are those of base spans; spans holds all. Null and empty texts have none. Repeated rows
    have the same spans.
    """
    texts = keyed(docs)
    spans = find_spans(texts)
    order = reduce(lambda e, k: F.when(F.col("kind") == k, KINDS.index(k)).otherwise(e), KINDS, F.lit(len(KINDS)))
    span = F.struct(order.alias("k"), "start", "end", "kind")
    kind = lambda k: F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    mine = spans.groupBy("doc_id", "tie").agg(*map(kind, KINDS), F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("b"), F.sort_array(F.collect_list(span)).alias("a"))
    mine = mine.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), *(f"n_{k}" for k in KINDS), joined(F.col("b")).alias("b"), joined(F.col("a")).alias("a"))
    out = texts.select("doc_id", "tie").join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    none = lambda k: F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(none, KINDS), F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("a", F.lit("")).alias("spans"))


def redact_stage(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in square brackets and n_chars set anew; other rows are as they were.

    Where spans overlap, the first names the kind and the cut covers all of them. A null text stays null.
    """
    spans = find_spans(keyed(docs))
    w = Window.partitionBy("doc_id", "tie").orderBy("start", F.desc("end"), "kind")
    seen = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.struct("start", "end", "seen", F.upper("kind").alias("kind"))
    cuts = spans.withColumn("seen", seen).where("end > seen").groupBy(F.col("doc_id").alias("_lw_d"), F.col("tie").alias("_lw_t")).agg(F.sort_array(F.collect_list(cut)).alias("_lw_cuts"), F.max("end").alias("_lw_end"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("_lw_d")) & (tie == F.col("_lw_t")), "left")
    text = F.col("text")
    piece = lambda s: F.when(s["start"] >= s["seen"], F.concat(F.substring(text, s["seen"] + 1, s["start"] - s["seen"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
    clean = F.concat(F.array_join(F.transform("_lw_cuts", piece), ""), F.substring(text, F.col("_lw_end") + 1, F.length(text)))
    new = F.when(F.col("_lw_cuts").isNull(), text).otherwise(clean)
    return joined.withColumn("text", new).withColumn("n_chars", F.when(F.col("_lw_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)
