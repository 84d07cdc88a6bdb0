"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from loamwork.llm import queries as Q
from loamwork.llm.dialogue import Chain, cheapest, concatenated, faulty_rows, audits, repair_conversations, repair_report, repaired_rows

SMALL = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
INK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = INK.findall(text)
        out.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "k")
        seen.add((role, text))
    return out


def plain_repair(rows, fault):
    """(cost, audit, repaired rows): the least over all edits, from the last row to the first."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state, room=3):
        found = []
        if i == n and state in ("", "a"):
            found.append((0, "", ()))
        turns = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]
        names = {"u": "user", "a": "assistant"}
        for x in turns:
            if x != "s" and room:
                c, a, r = best(i, x, room - 1)
                found.append((c + 5, "I" + a, ((names[x], ""), *r)))
        if i < n:
            role, text = rows[i]
            c, a, r = best(i + 1, state)
            found.append((c + 2, "D" + a, r))
            if fault[i] in "kt":
                more = 5 * (fault[i] == "t")
                for x in turns:
                    c, a, r = best(i + 1, x)
                    if role[:1] == x:
                        found.append((c + more, "K" + a, ((role, text), *r)))
                    if x in names:
                        found.append((c + 1 + more, "R" + a, ((names[x], text), *r)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "~", ())

    return best(0, "")


def report(conversations):
    out = {}
    ids = {r[0] for r in conversations}
    rows = damage(conversations)
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [(role, text) for _, role, text in own]
        f = faults(pairs)
        cost, audit, kept = plain_repair(tuple(pairs), tuple(f))
        first = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, digest)
        assert LEGAL.match("".join(r[0] for r, _ in kept))
    return out


def marked(rng, n):
    return [rng.choice("suuaaax") + rng.choice("kkkkbdtt") for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_search(seed):
    rng = random.Random(seed)
    for _ in range(25):
        marks = marked(rng, rng.randrange(0, 14))
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        want = plain_repair(tuple((names[m[0]], "t") for m in marks), tuple(m[1] for m in marks))
        assert cheapest(marks, 0, (0, 3)) == want[:2]
        for size in (1, 2, 5):
            parts = [marks[i : i + size] for i in range(0, len(marks), size)]
            solved = [("".join(m[0] for m in p), [(f, t, *got) for f in range(4) for t in range(4) if (got := cheapest(p, f, (t,)))]) for p in reversed(parts)]
            assert concatenated(solved)[:2] == want[:2]


def test_chain():
    texts = ["", "a", "b", "ab", "aab", "ba"]
    chains = [Chain(x, Chain(y, Chain(z, None))) for x in texts for y in texts for z in texts]
    for x, y in itertools.product(chains, chains):
        assert (x < y) == ("".join(x.pieces()) < "".join(y.pieces()))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Q.QUERIES["op11_repair"](spark, SMALL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == report(rows)


def made(rng, convs):
    rows = []
    for c in convs:
        for _ in range(rng.choice([1, 2, 7, 40])):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "who", "  ", "", None, "Same text?\n", f"line {rng.randrange(99)}. ", "ünï 漢字。"])
            rows.append((c, rng.choice([None, rng.randrange(40), rng.randrange(40)]), role, text))
    return rows


@pytest.mark.parametrize("segment", [4, 1024])
def test_edges(spark, segment):
    rng = random.Random(segment)
    # two rows of a turn are told apart by role and text; the plain version sorts by turn and role only, so turns differ
    rows, seen = [], set()
    for r in made(rng, [None, *range(30)]):
        if (r[0], r[1]) not in seen:
            rows.append(r)
            seen.add((r[0], r[1]))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id int, turn int, role string, text string, mark string, pos int")
    from loamwork.llm.dialogue import damaged

    got = repair_report(damaged(df), df, segment)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == report(rows)
    assert repair_conversations(df.where("false")).collect() == []


def test_repeats_and_long_texts(spark):
    rows = [(1, 0, "user", "Long. " * 200_000)] * 3 + [(1, 1, "assistant", "Yes.")] * 2 + [(2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair_report(df, df).collect()}
    assert (got[1].duplicate, got[1].audit, got[1].cost, got[1].illegal) == (3, "KDDKD", 6, 3)
    assert (got[2].blank, got[2].audit, got[2].gaps) == (1, "D", 0)
    m = faulty_rows(df)
    out = repaired_rows(m, audits(m)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.edit, r.role, len(r.text)) for r in out] == [(1, 0, "K", "user", 1_200_000), (1, 1, "K", "assistant", 4)]
