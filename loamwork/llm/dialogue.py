"""Repair of conversation structure: the cheapest edits that make roles alternate and drop faulty turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.storage import arrow_batches, stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: Where a role's initial leads from: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
START, ENDS, STATES = 0, (0, 3), range(4)
ROLE = {"u": "user", "a": "assistant"}
INSERTS = [(q, STEP[q, x]) for q in STATES for x in "ua" if (q, x) in STEP]


def _row_edges(mark: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of a row. mark: its initial (x: not one of s, u, a) and fault (k none, b blank, d duplicate, t truncated)."""
    edges = [(DELETE, q, q, COST[DELETE]) for q in STATES]
    if mark[1] in "kt":
        more = TRUNCATED if mark[1] == "t" else 0
        edges += [(KEEP, q, STEP[q, mark[0]], more) for q in STATES if (q, mark[0]) in STEP]
        edges += [(REROLE, q, STEP[q, x], COST[REROLE] + more) for q in STATES for x in "ua" if (q, x) in STEP]
    return edges


_EDGES = {a + b: _row_edges(a + b) for a in "suax" for b in "kbdt"}
_OUT = {m: [[(e, t, c) for e, f, t, c in es if f == q] for q in STATES] for m, es in _EDGES.items()}
_IN = {m: [[(e, f, c) for e, f, t, c in es if t == q] for q in STATES] for m, es in _EDGES.items()}
_OUT_NEW = [[t for f, t in INSERTS if f == q] for q in STATES]
_IN_NEW = [[f for f, t in INSERTS if t == q] for q in STATES]


def cheapest(marks: list[str], source: int, targets: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows that lead from source to one of targets; of equals the least audit.

    Nodes of the lattice are (rows read, state). A heap from the source and one from the targets grow in turn, the smaller
    head first, until their heads together exceed the best crossing: then every node of every cheapest path is settled
    on one side at least, so all crossings of that cost are known. What a node on the forward side has left is the best
    cost less its distance, if a crossing can be reached from it. The audit is read along nodes whose rest fits, the
    least letter of all of them at each step; two audits of one cost between the same nodes can't be each other's beginning.
    """
    n = len(marks)

    def ahead(i, q):
        for t in _OUT_NEW[q]:
            yield INSERT, i, t, COST[INSERT]
        if i < n:
            for e, t, c in _OUT[marks[i]][q]:
                yield e, i + 1, t, c

    def behind(i, q):
        for f in _IN_NEW[q]:
            yield INSERT, i, f, COST[INSERT]
        if i:
            for e, f, c in _IN[marks[i - 1]][q]:
                yield e, i - 1, f, c

    sides = [({(0, source): 0}, set(), [(0, 0, source)], ahead), ({(n, t): 0 for t in targets}, set(), [(0, n, t) for t in targets], behind)]
    heapify(sides[1][2])
    best = 0 if n == 0 and source in targets else None
    while all(heap for _, _, heap, _ in sides):
        heads = [heap[0][0] for _, _, heap, _ in sides]
        if best is not None and sum(heads) > best:
            break
        k = 0 if heads[0] <= heads[1] else 1
        dist, done, heap, edges = sides[k]
        other = sides[1 - k][0]
        d, i, q = heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        for _, j, t, c in edges(i, q):
            x, at = d + c, (j, t)
            if x < dist.get(at, x + 1):
                dist[at] = x
                heappush(heap, (x, j, t))
            if at in other and (best is None or x + other[at] < best):
                best = x + other[at]
    if best is None:
        return None
    (fore, front, _, _), (back, rear, _, _) = sides
    front.add((0, source))
    rest = {x: back[x] for x in rear.union((n, t) for t in targets)}
    # crossings: from a node settled forwards to one settled backwards, or one settled on both sides
    reach = [x for x in front if rest.get(x, best + 1) + fore[x] == best or any(fore[x] + c + rest.get((j, t), best + 1) == best for _, j, t, c in ahead(*x))]
    seen = set(reach)
    while reach:
        x = reach.pop()
        rest[x] = best - fore[x]
        for _, j, t, c in behind(*x):
            p = (j, t)
            if p in front and p not in seen and fore[p] + c == fore[x]:
                seen.add(p)
                reach.append(p)
    now, audit = {(0, source)}, []
    while not any(i == n and q in targets and not rest[i, q] for i, q in now):
        steps: dict[str, set] = {}
        for x in now:
            for e, j, t, c in ahead(*x):
                if rest.get((j, t), best + 1) + c == rest[x]:
                    steps.setdefault(e, set()).add((j, t))
        least = min(steps)
        audit.append(least)
        now = steps[least]
    return best, "".join(audit)


class Chain:
    """A text put together from pieces, compared without copying."""

    __slots__ = ("piece", "rest")

    def __init__(self, piece: str, rest: Chain | None):
        self.piece, self.rest = piece, rest

    def pieces(self) -> Iterator[str]:
        x: Chain | None = self
        while x is not None:
            yield x.piece
            x = x.rest

    def __lt__(self, other: Chain) -> bool:
        x, y, i, j = self, other, 0, 0
        while x is not None and y is not None:
            if x is y and i == j:
                return False
            k = min(len(x.piece) - i, len(y.piece) - j)
            a, b = x.piece[i : i + k], y.piece[j : j + k]
            if a != b:
                return a < b
            i, j = i + k, j + k
            if i == len(x.piece):
                x, i = x.rest, 0
            if y is not None and j == len(y.piece):
                y, j = y.rest, 0
        while y is not None and not y.piece[j:]:
            y, j = y.rest, 0
        return x is None and y is not None


def concatenated(segments: Iterable[tuple[str, list[tuple[int, int, int, str]]]]) -> tuple[int, str, int]:
    """(cost, audit, illegal) of a conversation from its segments, last first: (initials, paths (from, to, cost, audit))."""
    after: dict[int, tuple[int, Chain | None]] = dict.fromkeys(ENDS, (0, None))
    illegal, follows = 0, ""
    for initials, paths in segments:
        before: dict[int, tuple[int, Chain | None]] = {}
        for f, t, c, audit in paths:
            if t in after:
                new = (c + after[t][0], Chain(audit, after[t][1]))
                old = before.get(f)
                if old is None or new[0] < old[0] or new[0] == old[0] and new[1] < old[1]:
                    before[f] = new
        row = initials + follows
        illegal += sum(row[i : i + 2] not in ("su", "ua", "au") for i in range(len(row) - 1))
        after, follows = before, initials[0]
    cost, chain = after[START]
    return cost, "".join(chain.pieces()) if chain else "", illegal


def faulty_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos, mark of rows (conv_id, turn, role, text): a written table.

    pos ascends by conv_id, turn (nulls first both), role and text, so rows that agree in all are interchangeable; mark is as
    in _row_edges. A row is blank without a character other than blanks and line ends, a duplicate if its role and text
    came earlier in the conversation, truncated if its last such character is none of `.!?`; the first that holds counts.
    Null roles and texts are one space. Rows are dealt by ranges of conv_id and turn, so a long conversation has many tasks.
    """
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    r = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text")).withColumn("same", same)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "same"]
    r = stage(r.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "turns")
    again = r.groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = again.select(F.col("conv_id").alias("again_id"), F.col("same").alias("again"), "first")
    r = r.join(again, F.col("conv_id").eqNullSafe(F.col("again_id")) & (F.col("same") == F.col("again")), "left")
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    fault = F.when(bare == "", "b").when(F.col("pos") > F.col("first"), "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return stage(r.select("conv_id", "turn", "role", "text", "pos", F.concat(initial, fault).alias("mark")), "marked-turns")


def audits(marked: DataFrame, segment: int = 1024) -> DataFrame:
    """conv_id, cost, audit, illegal for every conversation of faulty_rows.

    A conversation is solved in segments of at most `segment` rows, each in any task: one that has a segment for itself in
    one search, a longer one by searches between all states, whose results are joined from the last segment to the
    first. Only edits meet there, a few letters a row, never texts.
    """
    seg = F.floor(F.col("pos") / segment)
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]), "")
    segments = stage(marked.groupBy("conv_id", seg.alias("seg")).agg(marks.alias("marks")), "segments")
    many = segments.groupBy(F.col("conv_id").alias("many_id")).count().where("count > 1").select("many_id", F.lit(True).alias("many"))
    segments = segments.join(many, F.col("conv_id").eqNullSafe(F.col("many_id")), "left").select("conv_id", "seg", "marks", F.col("many").isNotNull().alias("many"))

    def solve(batches):
        for batch in batches:
            out = []
            for text, several in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows = [text[i : i + 2] for i in range(0, len(text), 2)]
                asked = [(f, (t,)) for f in STATES for t in STATES] if several else [(START, ENDS)]
                found = [(f, t[0], *got) for f, t in asked if (got := cheapest(rows, f, t))]
                out.append({"initials": text[::2], "paths": [dict(zip("ftca", x, strict=True)) for x in found]})
            kind = pa.struct([("initials", pa.string()), ("paths", pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32()), ("c", pa.int64()), ("a", pa.string())])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["conv_id", "seg", "solved"])

    solved = segments.mapInArrow(solve, "conv_id long, seg long, solved struct<initials: string, paths: array<struct<f: int, t: int, c: long, a: string>>>")

    def join(batches):
        def finished(conv, held):
            return conv, *concatenated(held)

        rows = ((c.as_py(), s.as_py()) for b in batches for c, s in zip(b.column(0), b.column(1), strict=True))
        for chunk in _chunks(finished(conv, ((s["initials"], [tuple(p.values()) for p in s["paths"]]) for s in held)) for conv, held in _runs(rows)):
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "cost", "audit", "illegal"), x, strict=True)) for x in chunk], pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())]))

    ordered = solved.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).select("conv_id", "solved")
    return ordered.mapInArrow(join, "conv_id long, cost long, audit string, illegal long")


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, the other values one by one) of each run of rows of one key; what is not taken is skipped."""
    from itertools import groupby

    for key, run in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1] if len(r) == 2 else r[1:] for r in run)


def _chunks(rows: Iterator, size: int = 1000) -> Iterator[list]:
    from itertools import islice

    while chunk := list(islice(rows, size)):
        yield chunk


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that a conversation has after its edits."""
    q = START
    for e in audit:
        role, text = next(rows) if e != INSERT else ("", "")
        if e == DELETE:
            continue
        if e != KEEP:
            role = ROLE["a" if q == 2 else "u"]
        q = STEP[q, role[0]]
        yield e, role, text


def _with_audits(marked: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, role, text by conversation: its audit first (as text), then its rows in order."""
    both = marked.select("conv_id", "pos", "role", "text").unionByName(repairs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "role", "text")


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    for conv, run in _runs(rows):
        yield conv, edited(next(run)[1], run)


def repaired_rows(marked: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of every conversation after its edits."""

    def run(batches):
        rows = ((conv, k, *x) for conv, got in _conversations(batches) for k, x in enumerate(got))
        for chunk in _chunks(rows, 200):
            yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "place", "edit", "role", "text"), zip(*chunk, strict=True), strict=True)), pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))

    return _with_audits(marked, repairs).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repaired_hashes(marked: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired rows (role:text, joined by line feeds): rows pass one by one through one hash,
    which can't be split, so a conversation is read in one task, though never held there."""

    def run(batches):
        def hashed(rows):
            h = hashlib.sha256()
            for k, (_, role, text) in enumerate(rows):
                h.update(f"{chr(10) * bool(k)}{role}:{text}".encode())
            return h.hexdigest()

        for chunk in _chunks((conv, hashed(rows)) for conv, rows in _conversations(batches)):
            ids, hashes = zip(*chunk, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

    return _with_audits(marked, repairs).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; null roles and texts are one space) damaged by crc32 of conv_id:turn modulo 20:
    0 goes, 1 loses its text, 2 its `.!?`, 3 comes twice, 4 becomes the user's. A null in the sum's text is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("k")).where("k <> 0")
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.alias("_")).drop("_")


def repair_report(rows: DataFrame, ids: DataFrame, segment: int = 1024) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of ids.

    rows: conv_id, turn, role, text. An id without rows has zeros, an empty audit and the hash of nothing; a null id is one
    conversation; repeated rows are duplicates; gaps is 0 where all turns are null. Other columns are not read.
    """
    marked = faulty_rows(rows)
    with arrow_batches(rows.sparkSession):
        repairs = stage(audits(marked, segment), "audits")
        hashes = stage(repaired_hashes(marked, repairs), "hashes")

    def n(fault: str) -> Column:
        return F.count(F.when(F.right("mark", F.lit(1)) == fault, 1))

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = marked.groupBy("conv_id").agg(gaps.alias("gaps"), n("b").alias("blank"), n("d").alias("duplicate"), n("t").alias("truncated"))
    out = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    for part in (counts, repairs, hashes):
        out = out.join(part, F.col("id").eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in names))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations: see damaged and repair_report."""
    return repair_report(damaged(conversations), conversations)
