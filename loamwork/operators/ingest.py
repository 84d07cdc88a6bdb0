"""Formats, routing and chunking of raw documents (doc_id, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.histograms import any_of
from loamwork.functions.storage import stage
from loamwork.operators.quality_gate import chunk_quality_gate, length_quality  # noqa: F401

# What marks question-and-answer text, and the keys of such records, in order.
QA_PATTERNS = (r"(?isu)(Вопрос|Question|Q)\s*:.*?(Ответ|Answer|A)\s*:", r"(?isu)(В|Q)\s*\..*?(О|A)\s*\.\s*\S", r"(?isu)\bFAQ\b.*?\?", r"(?imu)^\s*\d+[.)]\s*[^\n]*\?\s*$")
QUESTION_KEYS = ("question", "input", "q", "вопрос", "query", "prompt")
ANSWER_KEYS = ("answer", "output", "a", "ответ", "response", "completion")
PAIR = r"(?isu)(?:Вопрос|Question|Q)[:\s]+(.*?)\s*(?:Ответ|Answer|A)[:\s]+(.*?)(?=\n\s*(?:Вопрос|Question|Q)[:\s]|$)"

#: Marked pairs, pairs marked by one letter, and lines of a question before a colon and its answer after it.
PAIRS = (PAIR, r"(?isu)(?:^|\n)\s*(?:В|Q)[:.]\s*(.*?)\s*\n\s*(?:О|A)[:.]\s*(.*?)(?=\n\s*(?:В|Q)[:.]|$)", r"(?mu)^([^:\n]+\?):?[ \t]*([^\n]+)$")


def is_json(c: Column) -> Column:
    """Whether the text is one JSON value and nothing else: in brackets, it is an array of one item."""
    one = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<variant>")
    return F.coalesce(F.size(one) == 1, F.lit(False))


def strip(c: Column) -> Column:
    """The text without blanks and line ends around it."""
    return F.trim(c, F.lit(" \t\n\r"))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def starts_ends(c: Column, a: str, b: str) -> Column:
    return F.startswith(c, F.lit(a)) & F.endswith(c, F.lit(b))


def format_of(content: Column) -> Column:
    t = strip(content)
    some = F.filter(F.slice(lines(t), 1, 20), lambda x: starts_ends(F.trim(x), "{", "}") & is_json(x))
    first = F.get(lines(t), F.lit(0))
    qa = any_of([t.rlike(p) for p in QA_PATTERNS])
    return (
        F.when(content.isNull() | (t == ""), "empty").when(starts_ends(t, "[", "]") & is_json(t), "json_array").when(starts_ends(t, "{", "}") & is_json(t), "json_object").when(F.size(some) >= 2, "jsonl")
        .when((F.size(lines(t)) >= 2) & first.rlike("[,;\t]") & first.rlike(r"\p{L}"), "csv").when(qa, "qa_text").otherwise("text")
    )


def detect_formats(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", format_of(F.col("content")).alias("format"))


def _has_keys(item: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(item, f"$.{k}") for k in keys)).isNotNull()


def route_of(content: Column, look: int = 5000) -> Column:
    """qa or universal, by the first `look` characters."""
    t = strip(F.substring(content, 1, look))
    first = F.get_json_object(t, "$[0]")
    pair = lambda x: _has_keys(x, QUESTION_KEYS) & _has_keys(x, ANSWER_KEYS)
    many = F.size(F.filter(F.slice(lines(t), 1, 10), lambda x: starts_ends(F.trim(x), "{", "}") & pair(x))) >= 3
    low = F.lower(t)
    marks = any_of([F.contains(low, F.lit(x)) for x in ("вопрос:", "question:", "q:", "в:")]) & any_of([F.contains(low, F.lit(x)) for x in ("ответ:", "answer:", "a:", "о:")])
    qa = (F.startswith(t, F.lit("[")) & pair(first)) | many | any_of([t.rlike(p) for p in QA_PATTERNS]) | marks
    return F.when(F.coalesce(qa, F.lit(False)), "qa").otherwise("universal")


def route_processor(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", route_of(F.col("content")).alias("route"))


def chunk_json_array(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text, json_type of the items of JSON arrays; nested arrays are dropped, objects stay JSON."""
    v = docs.where(format_of(F.col("content")) == "json_array").select("doc_id", F.from_json("content", "array<variant>").alias("v"))
    x = v.select("doc_id", F.posexplode("v").alias("idx", "x")).select("doc_id", "idx", F.schema_of_variant("x").alias("s"), "x")
    kind = F.when(F.startswith("s", F.lit("OBJECT")), "object").when(F.startswith("s", F.lit("ARRAY")), "array").otherwise("primitive")
    text = F.when(F.startswith("s", F.lit("OBJECT")), F.to_json("x")).otherwise(F.variant_get("x", "$", "string"))
    return x.select("doc_id", "idx", text.alias("text"), kind.alias("json_type")).where("json_type <> 'array' AND text IS NOT NULL")


def chunk_jsonl(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, idx (line), text, json_type: jsonl for objects, jsonl_primitive, or text_line for long lines that aren't JSON."""
    rows = docs.where(format_of(F.col("content")) == "jsonl").select("doc_id", F.posexplode(lines(F.col("content"))).alias("idx", "line")).where("trim(line) <> ''")
    t = F.trim("line")
    kind = F.when(is_json(t), F.when(F.startswith(t, F.lit("{")), "jsonl").otherwise("jsonl_primitive")).when(F.length(t) > least, "text_line")
    return rows.select("doc_id", "idx", t.alias("text"), kind.alias("json_type")).where("json_type IS NOT NULL")


def chunk_csv(docs: DataFrame) -> DataFrame:
    """doc_id, row_idx, text, delimiter: the first of `,`, `;` and tab that the first line holds (`,` if none); the header is a row."""
    d = docs.where(format_of(F.col("content")) == "csv").select("doc_id", strip(F.col("content")).alias("c"))
    first = F.get(lines(F.col("c")), F.lit(0))
    rows = d.select("doc_id", _delimiter(first).alias("delimiter"), F.posexplode(lines(F.col("c"))).alias("row_idx", "line")).where("trim(line) <> ''")
    return rows.select("doc_id", "row_idx", _csv_text(F.col("row_idx"), F.col("line"), F.col("delimiter")).alias("text"), "delimiter")


def _pairs(content: Column, least: int, patterns: tuple[str, ...]) -> Column:
    """Array of (idx, q, a) of extract_qa_pairs; null without a pair."""
    keep = lambda x: (F.length(x["q"]) > least) & (F.length(x["a"]) > least)
    found = []
    for p in patterns:
        side = lambda k: F.regexp_extract_all(content, F.lit(p), F.lit(k))  # noqa: B023, E731
        pairs = F.transform(F.arrays_zip(side(1).alias("q"), side(2).alias("a")), lambda x, i: F.struct(i.alias("idx"), F.trim(x["q"]).alias("q"), F.trim(x["a"]).alias("a")))
        good = F.filter(pairs, keep)
        found.append(F.when(F.size(good) > 0, good))
    return F.coalesce(*found)


def extract_qa_pairs(docs: DataFrame, least: int = 3, patterns: tuple[str, ...] = PAIRS) -> DataFrame:
    """doc_id, idx, question, answer: the pairs whose sides both have more than `least` characters.

    Of the patterns, the first with such a pair in a text is the one whose pairs it gives; idx counts its matches, those
    that are too short included.
    """
    rows = docs.select("doc_id", F.explode(_pairs(F.col("content"), least, patterns)).alias("x"))
    return rows.select("doc_id", "x.idx", F.col("x.q").alias("question"), F.col("x.a").alias("answer"))


#: What the route for question-and-answer files looks for: pairs that end at a blank line or the next question.
ROUTE_PAIRS = (
    r"(?isu)(?:Вопрос|Question|Q)[:\s]*(.*?)[\s\n]*(?:Ответ|Answer|A)[:\s]*(.*?)(?=\n\n|\n(?:Вопрос|Question|Q)[:\s]|$)",
    r"(?isu)(?:Q:|Question:|Вопрос:|В:)[\s\n]*(.*?)[\s\n]*(?:A:|Answer:|Ответ:|О:)[\s\n]*(.*?)(?=\n\n|\n(?:Q:|Question:|Вопрос:|В:)|$)",
)


#: Each route's least length, patterns, and the characters kept of question, answer and content.
ROUTES = (("qa", 4, ROUTE_PAIRS, 200, 500, None), ("universal", 3, PAIRS, 500, 2000, 5000))


def qa_text() -> Column:
    """A pair as one text."""
    return F.concat(F.lit("Вопрос: "), "question", F.lit("\n\nОтвет: "), "answer")


def qa_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, route, idx, question, answer, content, metadata of the pairs in docs (doc_id, content), by the route of each text.

    The qa route has two patterns and wants five characters on both sides; its metadata keep 200 characters of the question and
    500 of the answer. The universal route has three (see extract_qa_pairs), wants more than three, keeps 500 and 2000,
    and cuts the content at 5000. Texts without a pair have no rows.
    """
    routed = docs.withColumn("route", route_of(F.col("content")))
    found = []
    for route, least, patterns, q, a, most in ROUTES:
        pairs = extract_qa_pairs(routed.where(F.col("route") == route), least, patterns)
        text = qa_text()
        meta = F.create_map(F.lit("type"), F.lit("qa_pair"), F.lit("question"), F.substring("question", 1, q), F.lit("answer"), F.substring("answer", 1, a))
        found.append(pairs.select("doc_id", F.lit(route).alias("route"), "idx", "question", "answer", (text if most is None else F.substring(text, 1, most)).alias("content"), meta.alias("metadata")))
    return found[0].unionByName(found[1])


def _piece(kind: Column, idx: Column, part: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), idx.cast("int").alias("idx"), part.cast("int").alias("part"), text.alias("text"))


def _with(value: Column, f) -> Column:
    """f(value), which is worked out once, however often f's lambdas ask for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _json_pieces(c: Column) -> Column:
    """The rows of chunk_json_array."""
    first = F.transform(F.from_json(c, "array<variant>"), lambda x, i: F.struct(i.alias("idx"), F.schema_of_variant(x).alias("s"), x.alias("x")))
    kind = lambda y: F.when(F.startswith(y["s"], F.lit("OBJECT")), "json_object").otherwise("json_primitive")
    text = lambda y: F.when(F.startswith(y["s"], F.lit("OBJECT")), F.to_json(y["x"])).otherwise(F.variant_get(y["x"], "$", "string"))
    own = F.filter(first, lambda y: ~F.startswith(y["s"], F.lit("ARRAY")))
    return F.filter(F.transform(own, lambda y: _piece(kind(y), y["idx"], F.lit(0), text(y))), lambda x: x["text"].isNotNull())


def _jsonl_pieces(c: Column, least: int = 10) -> Column:
    """The rows of chunk_jsonl."""
    t = F.filter(F.transform(lines(c), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("idx"))), lambda x: x["t"] != "")
    kind = lambda x: F.when(is_json(x), F.when(F.startswith(x, F.lit("{")), "jsonl").otherwise("jsonl_primitive")).when(F.length(x) > least, "text_line")
    return F.filter(F.transform(t, lambda x: _piece(kind(x["t"]), x["idx"], F.lit(0), x["t"])), lambda x: x["kind"].isNotNull())


def _delimiter(first: Column) -> Column:
    return F.when(F.contains(first, F.lit(",")), ",").when(F.contains(first, F.lit(";")), ";").when(F.contains(first, F.lit("\t")), "\t").otherwise(",")


def _csv_text(idx: Column, line: Column, delimiter: Column) -> Column:
    cells = F.transform(F.split(line, F.concat(F.lit("["), delimiter, F.lit("]"))), lambda x: F.trim(x))
    return F.concat(F.lit("Строка "), (idx + 1).cast("string"), F.lit(": "), F.array_join(cells, ", "))


def _csv_pieces(c: Column) -> Column:
    """The rows of chunk_csv."""

    def rows(z: Column) -> Column:
        every = F.transform(z["rows"], lambda x, i: F.struct(x.alias("line"), i.alias("idx")))
        return F.transform(F.filter(every, lambda x: F.trim(x["line"]) != ""), lambda x: _piece(F.lit("csv_row"), x["idx"], F.lit(0), _csv_text(x["idx"], x["line"], z["by"])))

    both = _with(lines(strip(c)), lambda r: F.struct(r.alias("rows"), _delimiter(F.get(r, F.lit(0))).alias("by")))
    return _with(both, rows)


def _paragraph_pieces(c: Column, size: int = 1000, overlap: int = 100, least: int = 10, most: int = 5000) -> Column:
    """The rows of chunk_paragraphs."""
    own = F.filter(F.transform(_paragraphs(c), lambda p, i: F.struct(i.alias("idx"), F.trim(p).alias("p"))), lambda y: F.length(y["p"]) > least)
    parts = lambda y: F.transform(_windowed(y["p"], size, overlap), lambda w, j: _piece(F.lit("paragraph"), y["idx"], j, _plain(w["text"], most)))
    return F.flatten(F.transform(own, parts))


def _pair_pieces(c: Column, least: int, patterns: tuple[str, ...], most: int | None) -> Column:
    """The rows of qa_chunks for one route."""

    def piece(x: Column) -> Column:
        text = F.concat(F.lit("Вопрос: "), x["q"], F.lit("\n\nОтвет: "), x["a"])
        return _piece(F.lit("qa_pair"), x["idx"], F.lit(0), text if most is None else F.substring(text, 1, most))

    return F.transform(_pairs(c, least, patterns), piece)


def chunked_files(docs: DataFrame) -> DataFrame:
    """docs (content and others) with chunks: an array of the kind, idx, part and text of each row of chunk_files. Rows stay where they are, so
    docs may be a stream."""
    c = F.col("content")
    d = docs.withColumns({"_format": format_of(c), "_route": route_of(c)})
    f = F.col("_format")
    pairs = [F.when(f.isin("qa_text", "text") & (F.col("_route") == route), _pair_pieces(c, least, patterns, most)) for route, least, patterns, _, _, most in ROUTES]
    other = F.when(f == "json_array", _json_pieces(c)).when(f == "jsonl", _jsonl_pieces(c)).when(f == "csv", _csv_pieces(c)).when(f.isin("text", "qa_text", "json_object"), _paragraph_pieces(c))
    d = d.withColumn("_chunks", F.coalesce(*pairs, other))
    whole = F.when((F.length("content") > 10) & (f != "empty"), F.array(_piece(F.lit("whole"), F.lit(0), F.lit(0), c)))
    return d.withColumn("chunks", F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(whole)).drop("_format", "_route", "_chunks")


def chunk_files(docs: DataFrame) -> DataFrame:
    """doc_id, kind, idx, part, text of the chunks of docs (doc_id, content), each by its format: items of JSON arrays, lines of JSON, rows
    of CSV, and of other texts the pairs of questions and answers (by route), else paragraphs. A text of over ten characters without
    any chunk is one itself; empty texts and null ones have none."""
    return chunked_files(docs.select("doc_id", "content")).select("doc_id", F.explode("chunks").alias("x")).select("doc_id", "x.*")


def qa_records(messages: DataFrame, least: int = 5) -> DataFrame:
    """conv_id, turn, kind, question, answer: each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = messages.withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).where("role = 'user'")
    a = F.when(F.col("r2") == "assistant", F.col("t2"))
    q_ok, a_ok = F.length("text") >= least, F.coalesce(F.length(a) >= least, F.lit(False))
    kind = F.when(q_ok & a_ok, "qa_pair").when(q_ok, "question_only").when(a_ok, "answer_only").otherwise("neither")
    return nxt.select("conv_id", "turn", kind.alias("kind"), F.col("text").alias("question"), a.alias("answer"))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (offset, text) of windows of `size` characters that start every size - overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def chunk_fixed(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    return docs.where(F.length("content") > 0).select("doc_id", F.explode(windows(F.col("content"), size, overlap)).alias("x")).select("doc_id", "x.offset", "x.text")


def _paragraphs(c: Column) -> Column:
    said = F.filter(F.split(c, "[.!?]+"), lambda x: F.length(F.trim(x)) > 20)
    return F.when(F.contains(c, F.lit("\n\n")), F.split(c, "\n\n")).when(F.contains(c, F.lit("\n")), F.split(c, "\n")).otherwise(said)


def _windowed(p: Column, size: int, overlap: int) -> Column:
    return F.when(F.length(p) <= size, F.array(F.struct(F.lit(0).alias("offset"), p.alias("text")))).otherwise(windows(p, size, overlap))


def _plain(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), 1, most)


def chunk_paragraphs(docs: DataFrame, size: int = 1000, overlap: int = 100, least: int = 10, most: int = 5000) -> DataFrame:
    """doc_id, idx, part, text: paragraphs (blank lines, else lines, else sentences of over 20 characters), long ones in windows."""
    p = docs.select("doc_id", F.posexplode(_paragraphs(F.col("content"))).alias("idx", "p")).withColumn("p", F.trim("p")).where(F.length("p") > least)
    x = p.select("doc_id", "idx", F.posexplode(_windowed(F.col("p"), size, overlap)).alias("part", "x"))
    return x.select("doc_id", "idx", "part", _plain(F.col("x.text"), most).alias("text"))


def chunk_packed(docs: DataFrame, size: int = 1500) -> DataFrame:
    """doc_id, chunk_idx, n_paragraphs, length: greedy packing of paragraphs by a fold in the row: one of 0.7 * size or more
    stands alone; others join while the lengths add up to size at most."""
    ps = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<struct<n:int,len:int>>")
    start = F.struct(empty.alias("done"), F.lit(0).alias("n"), F.lit(0).alias("len"))

    def flush(s):
        return F.when(s["n"] > 0, F.concat(s["done"], F.array(F.struct(s["n"].alias("n"), s["len"].alias("len"))))).otherwise(s["done"])

    def add(s, x):
        k = F.length(x)
        alone = F.concat(flush(s), F.array(F.struct(F.lit(1).alias("n"), k.alias("len"))))
        big = F.struct(alone.alias("done"), F.lit(0).alias("n"), F.lit(0).alias("len"))
        join = F.struct(s["done"].alias("done"), (s["n"] + 1).alias("n"), (s["len"] + k).alias("len"))
        new = F.struct(flush(s).alias("done"), F.lit(1).alias("n"), k.alias("len"))
        return F.when(k >= 0.7 * size, big).when(s["len"] + k <= size, join).otherwise(new)

    chunks = F.aggregate(ps, start, add, flush)
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "c")).select("doc_id", "chunk_idx", F.col("c.n").alias("n_paragraphs"), F.col("c.len").alias("length"))


def chunk_page_blocks(pages: DataFrame, n: int = 8) -> DataFrame:
    """chunk_id, page_id, length: paragraphs of over 100 characters, else sentences of over 80; the first n, with a letter, 50 or more.
    pages: page_id, url, content."""
    ps = F.filter(F.split("content", "\n"), lambda x: F.length(F.trim(x)) > 100)
    ss = F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 80)
    blocks = F.slice(F.when(F.size(ps) > 0, ps).otherwise(ss), 1, n)
    x = pages.select("page_id", F.substring(F.md5("url"), 1, 8).alias("h"), F.posexplode(blocks).alias("i", "t"))
    x = x.where((F.length("t") >= 50) & F.col("t").rlike(r"\p{L}"))
    return x.select(F.concat_ws("_", "h", F.col("i").cast("string")).alias("chunk_id"), "page_id", F.least(F.length("t"), F.lit(8000)).alias("length"))


def fallback_chunks(docs: DataFrame, chunks: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_chunks, fallback: documents without chunks but of over `least` characters get one of the whole text."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = docs.join(n, "doc_id", "left")
    alone = F.col("n").isNull() & (F.length("content") > least)
    return j.select("doc_id", F.when(alone, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_chunks"), alone.alias("fallback"))


def ingest_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """format, route, n_files, n_chunks, total_length, success: by format and route."""
    per = docs.select("doc_id", format_of(F.col("content")).alias("format"), route_of(F.col("content")).alias("route"), F.length("content").alias("len"))
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(n, "doc_id", "left")
    return j.groupBy("format", "route").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("n", F.lit(0))).alias("n_chunks"), F.sum("len").cast("long").alias("total_length"), F.min(F.coalesce("n", F.lit(0)) > 0).alias("success"))

