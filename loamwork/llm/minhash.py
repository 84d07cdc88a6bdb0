"""MinHash near-duplicates with tensored banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.numbering import number_rows
from loamwork.functions.storage import arrow_batches, stage
from loamwork.llm.shingles import U, mix, shingle_sets
from loamwork.operators.components import connected_components


def signatures(docs: DataFrame, words: int, left: tuple[int, int], right: tuple[int, int], seed: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), n (distinct shingles), s0 and s1 (hashes of the whole set), a and b (band hashes of two collections).

    left and right: (bands, minhashes in a band). A text without words has n = 0 and empty a and b.
    """
    bands = [left[1]] * left[0] + [right[1]] * right[0]
    rng = np.random.default_rng(seed)
    salts, odd = rng.integers(0, 2**63, sum(bands), U), rng.integers(0, 2**62, sum(bands), U) * U(2) + U(1)
    cuts = np.cumsum([0, *bands])

    def sign(batches):
        for batch in batches:
            n, s0, s1, rows = [], [], [], []
            for x in shingle_sets(batch.column(2), words):
                n.append(len(x))
                s0.append(int(mix(x).sum(dtype=U).astype("i8")))
                s1.append(int(mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=U).astype("i8")))
                if not len(x):
                    rows.append(np.zeros(0, "i8"))
                    continue
                low = np.array([((x ^ s) * o).min() for s, o in zip(salts, odd, strict=True)], U)
                h = np.zeros(len(bands), U)
                for j in range(max(bands)):
                    deep = np.flatnonzero(np.diff(cuts) > j)
                    h[deep] = mix(h[deep] + low[cuts[deep] + j] + U(j + 1))
                rows.append(h.astype("i8"))
            a, b = ([x[: left[0]] for x in rows], [x[left[0] :] for x in rows])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(a, longs), pa.array(b, longs)], ["doc_id", "th", "n", "s0", "s1", "a", "b"])

    return keyed(docs).mapInArrow(sign, "doc_id long, th long, n long, s0 long, s1 long, a array<long>, b array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text: what names a row is its id and a hash of its text (null: empty), for several texts may share an id."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: id, text, ids once each."""

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows (rep, ...), those whose key two different reps have. Keys are counted before rows meet: a hot key is only
    a join with many rows on one side, which Spark splits."""
    seen = rows.groupBy(*key).agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    return rows.join(seen, key)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is component_id) for every row of docs. See components_of."""
    out = components_of(docs, words, percent, **how)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components_of(docs: DataFrame, words: int = 5, percent: int = 80, left: tuple[int, int] = (16, 4), right: tuple[int, int] = (8, 2), pivots: int = 2) -> DataFrame:
    """doc_id, th, n_shingles, component_id, first for every row of docs (doc_id, text).

    Documents link where the Jaccard similarity of their sets of `words`-word shingles is percent / 100 at least. Texts
    without words are empty and link with nothing; neither do rows without doc_id (component_id null, first). Repeated
    rows have one component. Several texts may share an id: each goes its own way, and component_id is the smallest
    doc_id of any row of the component. first: the row has the least (doc_id, th) of its component.

    Equal sets form classes (by size and two 64-bit sums), numbered from 0; the row of least (doc_id, th) stands for its
    class. Two collections of band hashes, left and
    right, are made; every pair of a left and a right band is a table, keyed by both: left[0] * right[0] tables for
    left[0] * left[1] + right[0] * right[1] minhashes. A left band that no other class has can't be part of a shared
    key, so it is dropped before pairs are formed. A pair at the threshold meets with a probability over 0.999.

    Shared buckets are settled by components, not by all pairs: members are checked against pivots first and joined
    components are contracted. In buckets that still hold two components, every pair across them is checked or ruled
    out by an exact bound (unsettled_pairs). So each pair that shares a bucket is linked by checked links, checked
    itself, or proved apart; there is no cap.
    """
    spark = docs.sparkSession
    with arrow_batches(spark):
        sigs = stage(signatures(docs, words, left, right), "sigs")
    sets = ["n", "s0", "s1"]
    usable = sigs.where("n > 0 AND doc_id IS NOT NULL")
    rows = usable.groupBy(*sets, "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    heads = rows.groupBy(*sets).agg(F.min(F.struct("doc_id", "th", "c")).alias("head"))
    classes = number_rows(stage(heads, "heads"), sets, "rep").select(*sets, "rep", "head.doc_id", "head.th", "head.c")
    classes = stage(classes, "classes")
    head = classes.select("rep", "doc_id", "th", "c")
    least = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1) or n == 9_999)  # smaller sets link with equal ones only
    firsts = usable.where(F.col("n") >= least).select("doc_id", "th", "n", "a", "b").join(head, ["doc_id", "th"])
    firsts = _one_each(stage(firsts, "firsts"), "rep")  # doc_id: the class's smallest
    lefts = _shared(firsts.select("rep", F.posexplode("a").alias("i", "x")), ["i", "x"])
    rights = firsts.select("rep", "n", F.col("doc_id").alias("low"), "b")
    keys = lefts.join(rights, "rep").select("rep", "n", "low", "i", "x", F.posexplode("b").alias("j", "y")).select("rep", "n", "low", F.xxhash64("i", "x", "j", "y").alias("key"))
    members = stage(_shared(keys, ["key"]).distinct(), "members")
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    wanted = stage(head.join(members.select("rep").distinct(), "rep").withColumnRenamed("rep", "id"), "ids")
    texts = _one_each(stage(sized_join(keyed(docs), wanted, ["doc_id", "th"]), "texts"), "id").select("id", "text")

    at: DataFrame | None = None  # rep, comp: where components stand
    tried: DataFrame | None = None

    def settle(pairs: DataFrame) -> None:
        nonlocal at, tried
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        if pairs.isEmpty():
            return
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = verified(pairs, texts, words, percent)
        if at is not None:
            ca, cb = at.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), at.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
            links = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        with arrow_batches(spark, 500):
            links = stage(links, "checked")
        found = connected_components(links)
        if at is None:
            at = stage(found.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "comps")
        else:
            moved = at.join(found.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"))
            new = found.join(at.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
            at = stage(moved.unionByName(new), "comps")

    open_ = members.withColumn("comp", F.col("rep"))
    for k in range(pivots):
        mark = F.xxhash64("rep", F.lit(k)) if k else F.col("low")  # the first text of a group is often what the others were made from
        marked = open_.withColumn("mark", mark)
        lows = marked.groupBy("key").agg(F.min("mark").alias("mark"))
        chosen = marked.join(lows, ["key", "mark"]).select("key", F.col("rep").alias("pivot"), F.col("low").alias("pl"), F.col("n").alias("m"), F.col("comp").alias("pc"))
        met = open_.join(chosen, "key").where((F.col("comp") != F.col("pc")) & near)
        if k == 0:  # one pivot for each member will do at first
            met = met.groupBy("rep").agg(F.min_by("pivot", F.struct("pl", "pivot")).alias("pivot"))
        settle(met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")))
        now = members.withColumn("comp", F.col("rep")) if at is None else members.join(at, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        split = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
        open_ = stage(now.join(split, "key"), "open")
        if open_.isEmpty():
            break
    else:
        settle(unsettled_pairs(open_, texts, words, percent))

    tops = classes.select(*sets, "rep", F.struct("doc_id", "th").alias("own"))
    if at is not None:
        moved = stage(tops.join(at, "rep"), "moved")  # only classes that link
        tops = tops.join(moved.join(moved.groupBy("comp").agg(F.min("own").alias("top")), "comp").select("rep", "top"), "rep", "left")
        tops = tops.withColumn("own", F.coalesce("top", "own"))
    out = sigs.select("doc_id", "th", *sets).join(tops.select(*sets, "own"), sets, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    comp = F.when(alone, F.col("doc_id")).otherwise(F.col("own.doc_id"))
    first = alone | ((F.col("doc_id") == F.col("own.doc_id")) & (F.col("th") == F.col("own.th")))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), comp.alias("component_id"), first.alias("first"))


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One of the rows of each key; c counts them, and only those of a count over 1, which are alike, are grouped."""
    many = rows.where("c > 1")
    if many.isEmpty():
        return rows
    one = many.groupBy(key).agg(*(F.first(x).alias(x) for x in rows.columns if x != key))
    return rows.where("c = 1").unionByName(stage(one, "one-each"))


def shingle_arrays(texts: DataFrame, words: int) -> DataFrame:
    """rep, elems: the whole shingle set of each text (id, text)."""

    def sets(batches):
        for batch in batches:
            found = [x.astype("i8") for x in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["rep", "elems"])

    return texts.select("id", "text").mapInArrow(sets, "rep long, elems array<long>")


def unsettled_pairs(open_: DataFrame, texts: DataFrame, words: int, percent: int, small: int = 32, slice_rows: int = 1000) -> DataFrame:
    """Pairs (a, b) of open_ (key, rep, n, comp) that may link: all across the components of a bucket but those ruled out.

    In buckets of at most `small` members every pair across components is one. Larger buckets are joined to clusters by
    the members they share, and each cluster gets a consensus p, the shingles that over half of its members have. With
    h(x) the size of the difference of x and p, and o the overlap of two differences, the difference of x and y has
    h(x) + h(y) - 2 o shingles, and they link if that is at most q (n(x) + n(y)), q = (100 - percent) / (100 + percent).
    If h(x) > q (n(x) + n(p)), a link needs o > m(y) = (h(y) - q (n(y) - n(p))) / 2. So y's difference, but for
    floor(m(y)) of it, must hold a shingle of x's difference, and the rarest of y's will do: a join on shingles finds
    all such pairs. Copies of one text differ from p in shingles of their own, so hardly any meet. Members x of the cluster's largest component are
    joined already; the few x outside it but close to p are compared with the whole cluster by their differences.
    """
    close = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    keep, lose = 100 + percent, 100 - percent
    counted = stage(open_.join(open_.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key"), "counted")
    few = counted.where(F.col("c") <= small).select("key", "rep", "n", "comp")
    other = few.select("key", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("comp").alias("rc"))
    pairs = few.join(other, "key").where((F.col("rep") < F.col("r")) & (F.col("comp") != F.col("rc")) & close).select(F.col("rep").alias("a"), F.col("r").alias("b"))
    many = counted.where(F.col("c") > small)
    if many.isEmpty():
        return pairs
    stars = many.join(many.groupBy("key").agg(F.min("rep").alias("hub")), "key").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = connected_components(stars.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    mine = many.select("rep", "n", "comp").distinct().join(clusters, "rep")
    with arrow_batches(texts.sparkSession):
        sets = stage(mine.join(shingle_arrays(texts, words), "rep"), "cluster-sets")
    parts = sets.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"))
    info = parts.groupBy("cluster").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top")).select("cluster", "size", F.col("top.comp").alias("main"))
    info = stage(info.withColumn("slices", F.ceil(F.col("size") / slice_rows).cast("int")), "clusters")
    usual = sets.select("cluster", F.explode("elems").alias("e")).groupBy("cluster", "e").agg(F.count(F.lit(1)).alias("k"))
    p = sized_join(usual, info, ["cluster"]).where("2 * k > size").groupBy("cluster").agg(F.collect_set("e").alias("p"))
    # a cluster's members are dealt to slices; what all of them need is sent to each slice, so a large cluster is many groups
    own = sized_join(sets, info, ["cluster"]).withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")).drop("slices", "size")
    spread = lambda rows: sized_join(rows, info.select("cluster", "slices"), ["cluster"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    d = own.join(spread(stage(p, "consensus")), ["cluster", "slice"], "left").withColumn("p", F.coalesce("p", F.array().cast("array<long>")))
    d = d.withColumn("d", F.concat(F.array_except("elems", "p"), F.array_except("p", "elems")))
    h, n, np_ = F.size("d").cast("long"), F.col("n"), F.size("p").cast("long")
    m = F.floor((h * keep - (n - np_) * lose) / (2 * keep))
    d = d.select("cluster", "slice", "rep", "n", "comp", "d", (F.col("comp") != F.col("main")).alias("outside"), (h * keep <= (n + np_) * lose).alias("near_p"), (h - m).alias("part"))
    d = stage(d, "differences")
    x = d.where("outside AND NOT near_p").select("cluster", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("comp").alias("rc"), F.explode("d").alias("e"))
    y = d.select("cluster", "rep", "n", "comp", "part", F.explode("d").alias("e"))
    y = y.join(y.groupBy("cluster", "e").agg(F.count(F.lit(1)).alias("k")), ["cluster", "e"])
    rarest = F.row_number().over(Window.partitionBy("rep").orderBy("k", "e"))
    y = y.withColumn("at", rarest).where("at <= part").select("cluster", "rep", "n", "comp", "e")
    met = x.join(y, ["cluster", "e"]).where((F.col("comp") != F.col("rc")) & close).select("rep", "r")
    z = d.where("outside AND near_p").select("cluster", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("comp").alias("rc"), F.col("d").alias("e"))
    apart = F.size("d") + F.size("e") - 2 * F.size(F.array_intersect("d", "e"))  # the size of the difference of the two sets
    linked = (F.col("comp") != F.col("rc")) & close & (apart * keep <= (F.col("n") + F.col("m")) * lose)
    direct = d.select("cluster", "slice", "rep", "n", "comp", "d").join(spread(z), ["cluster", "slice"]).where(linked).select("rep", "r")
    both = met.unionByName(direct).select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b"))
    return pairs.unionByName(both)


def dedup_stage(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept: one row of each group of near-duplicates, and all that link with nothing.

    A group keeps the row of the least (doc_id, hash of its text), once if it is repeated. Rows are dropped, not ids:
    another text under a dropped row's id has its own place. Rows without words or doc_id stay.
    """
    found = stage(components_of(docs, words, percent), "found")
    key = ["_lw_id", "_lw_th"]
    named = found.withColumnsRenamed({"doc_id": "_lw_id", "th": "_lw_th"})
    gone = stage(named.where("NOT first").select(*key).distinct(), "gone")
    many = stage(named.where("first AND n_shingles > 0 AND _lw_id IS NOT NULL").groupBy(*key).count().where("count > 1").select(*key), "many")
    rows = docs.withColumns({"_lw_id": F.col("doc_id").cast("long"), "_lw_th": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = sized_join(rows, gone, key, "left_anti")
    if not many.isEmpty():
        kept = sized_join(kept, many, key, "left_anti").unionByName(sized_join(kept, many, key, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns)
