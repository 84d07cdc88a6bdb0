"""Each operator against a plain version of what it promises."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamwork.llm import queries as Q
from loamwork.llm.arc import arc_file, archive_pages, parse_arc, warc_date
from loamwork.llm.minhash import near_duplicates
from loamwork.llm.mixing import capped_shares, mix_plan, apply_plan, route
from loamwork.llm.packing import Encoder, best_fit
from loamwork.llm.sharding import domain, feistel
from loamwork.llm.vectors import near_vectors

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(6))
def test_route_is_a_largest_flow_of_least_cost(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c"]
    every = [s for n in (1, 2, 3) for s in itertools.combinations(sources, n)]
    patterns = [(p, rng.randint(0, 30)) for p in rng.sample(every, 5)]
    quotas = {s: rng.randint(0, 60) for s in sources}
    copies = 3
    sent = route(patterns, quotas, copies)
    totals = [sum(x.values()) for x in sent]
    assert all(v >= 0 for x in sent for v in x.values()) and all(t <= copies * w for t, (_, w) in zip(totals, patterns, strict=True))
    assert all(sum(x.get(s, 0) for x in sent) <= quotas[s] for s in sources)
    for k in range(1, copies + 1):  # with k readings at most, no flow is larger: by the cuts of the network
        cut = min(sum(quotas[s] for s in t) + sum(k * w for p, w in patterns if not set(p) <= set(t)) for n in range(4) for t in itertools.combinations(sources, n))
        assert sum(min(t, k * w) for t, (_, w) in zip(totals, patterns, strict=True)) == cut


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", "c"], 10 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    total = sum(r[2] for r in rows)
    quotas = {"a": total * 0.7, "b": total * 0.2, "c": total * 0.3}
    plan = mix_plan(df, quotas, copies=2, buckets=64)
    got = apply_plan(df, F.col("sources"), plan).collect()
    taken = sum(r.passes * r["size"] for r in got)
    assert abs(taken - sum(quotas.values())) < 60 and max(r.passes for r in got) <= 2
    again = apply_plan(df.repartition(7), F.col("sources"), mix_plan(df.repartition(5), quotas, copies=2, buckets=64)).collect()
    assert {r.doc_id: r.passes for r in got} == {r.doc_id: r.passes for r in again}


def test_mix_targets(spark, docs):
    got = Q.op1_mix_sources(spark, SMALL).collect()
    source = {d.doc_id: d.source for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(WORD.findall(d.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, capped_shares([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2), strict=True))
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 4099])
def test_feistel_permutes(spark, n):
    got = [r.p for r in spark.range(n).select(feistel(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    a, b = domain(n)
    assert a * b >= n


def test_shards(spark, docs):
    got = Q.op2_shard(spark, SMALL).collect()
    text = {d.doc_id: d.text for d in docs}
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = Q.op2_shard(spark, SMALL).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in Q.op3_language_id(spark, MEDIUM).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.98 and not any(r.rejected for r in got)


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = [r for r in Q.op6_quality(spark, MEDIUM).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.93


def test_fingerprints(spark, docs):
    rows = sorted(docs, key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in Q.op4_fingerprints(spark, SMALL).collect()}

    def weights(t):
        return {k: n * len(k) for k, n in Counter(WORD.findall(t)).items()}

    def jaccard(x, y):
        keys = x.keys() | y.keys()
        return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))

    off = []
    for i, d in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        half = len(d.text) // 2
        edited = d.text[: len(d.text) - half] + after[:half]
        r = got[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(weights(d.text), weights(edited)), r.near_next - jaccard(weights(d.text), weights(after))]
    assert np.abs(off).mean() < 0.06 and abs(np.mean(off)) < 0.02


@pytest.mark.parametrize("theta", [0.5, 3.0])
def test_fingerprints_do_not_depend_on_the_bound(spark, theta):
    from loamwork.llm.fingerprints import fingerprint_documents

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").select("doc_id", "text").unionByName(spark.createDataFrame([(60, ""), (61, None), (61, "x y"), (62, "one")], "doc_id long, text string"))
    assert sorted(map(tuple, fingerprint_documents(rows, theta).collect())) == sorted(map(tuple, fingerprint_documents(rows, 20.0).collect()))


def test_fingerprints_of_skewed_and_short_texts(spark):
    from loamwork.llm.fingerprints import fingerprint_documents

    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = ["line " * 1000 + words(50), "line " * 1000 + words(50), "a bb", "a cccccc", "dd " * 30 + "e", "dd " * 10 + "e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprint_documents(rows).collect()}
    for i in (0, 2, 4):
        x, y = ({k: n * len(k) for k, n in Counter(t.split()).items()} for t in texts[i : i + 2])
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        assert abs(got[i] - true) < 0.15, (i, got[i], true)


def test_arc():
    records = [("http://a/b c", "1.2.3.4", "20240131120000", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n\nhttp://x 1 2 3 4\n"), ("dns:x", "0.0.0.0", "2024", "text/dns", b"")]
    for version in (1, 2):
        data = arc_file(records, version)
        got = list(parse_arc(data))
        assert [(h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"], c, cut) for h, c, cut in got] == [(*r, False) for r in records]
        assert [x[2] for x in parse_arc(data[: data.index(b"body") + 2])] == [True]
    assert warc_date("20240131120000") == "2024-01-31T12:00:00Z" and warc_date("2024") == "2024-01-01T00:00:00Z" and warc_date("?") == "1970-01-01T00:00:00Z"


def test_warc_of_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    copies = pages.where("page_id < 20").select((F.col("page_id") + 10_000).alias("page_id"), "url", "html")
    rows = pages.unionByName(copies).unionByName(copies.withColumn("page_id", F.col("page_id") + 10_000)).collect()
    got = {r.page_id: r for r in archive_pages(spark.createDataFrame(rows, pages.schema)).collect()}
    top = {}
    for r in rows:
        top[r.html] = max(top.get(r.html, -1), r.page_id)
    assert len(got) == len(rows)
    for r in rows:
        body = (r.html or "").encode()
        first = top[r.html] if len(body) >= 1000 and top[r.html] != r.page_id else None
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if first is not None else "response", first)


@pytest.mark.parametrize("tile", [32, 1024])
def test_vectors(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 16))
    rows = [(i, rng.standard_normal(16), i % 3) for i in range(300)]
    rows += [(1000 + i, base[i % 4] + rng.standard_normal(16) * 0.12, 1) for i in range(200)]
    rows += [(2000 + i, base[0], 1) for i in range(30)]
    v = np.array([r[1] for r in rows], np.float32)
    df = spark.createDataFrame([(r[0], [float(y) for y in x], r[2]) for r, x in zip(rows, v, strict=True)], "vec_id long, embedding array<float>, label int")
    x = v.astype(float)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    label, ids = np.array([r[2] for r in rows]), [r[0] for r in rows]
    link = (cos >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    root = roots(ids, [(ids[a], ids[b]) for a, b in np.argwhere(link)])
    want = {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, link.sum(1), strict=True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, 0.93, tile).collect()} == want


def test_linked_blocks():
    from loamwork.llm.vectors import linked_blocks

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((90, 12)), rng.standard_normal(12) + rng.standard_normal((60, 12)) * 0.2])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    every, some, rest = np.arange(150), np.arange(0, 150, 2), np.arange(1, 150, 2)
    for lhs, rhs in ((every, None), (some, rest)):
        got = {(min(i, j), max(i, j)) for p, q in linked_blocks(x, lhs, rhs, axes, 0.93, block=16) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if cos[i, j] >= 0.93 and (rhs is None or (i - j) % 2)}
        assert got == want and want


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * y, 10)) for y in x[1::2])) % 10 == 0


def base_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                yield kind, m.start(), m.end()


def test_pii(spark, docs):
    from loamwork.llm.pii import pii_documents

    odd = ["a@b.c+d@e.f.g, +1 (555) 010-9999 4111-1111 1111 1111", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "x" * 3000 + "@y.z 🙂 q@r.st", "+1+22 333 4444 55555 4111111111111111", "5 5 5 5 5 5 5 5 5 5 5 5 5 5", "ä@b.de @a.b a@b"]
    rows = [(d.doc_id, d.text) for d in docs] + [(10_000 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in pii_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [f"{k}:{a}:{b}" for k, a, b in base_spans(t)]
        n = Counter(s.split(":")[0] for s in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone")), t[:80]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_pii_written_out(spark):
    from loamwork.llm.pii import pii_documents, redact_stage

    hidden = ["jo.doe (at) mail3.example (dot) com", "jo[at]example[dot]com", "1 (325) 555-8094", "325.555.8094", "4111.1111.1111.1111", "4111.1111-1111 1111", "120. 121. 90. 252"]
    sober = ["4111.1111.1111.1112", "300. 400. 500. 600", "3 @ 4.50", "a7e13255558094bf"]
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    cases = [(10**9 + i, f"the thing and {x} of the thing. Then more") for i, x in enumerate(hidden + sober)]
    extra = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in cases], "doc_id long, text string, lang string, source string, n_chars int")
    every = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars")).unionByName(extra)
    got = {r.doc_id: r for r in pii_documents(every).where(f"doc_id >= {10**9}").collect()}
    kinds = ["email"] * 2 + ["phone"] * 2 + ["card"] * 2 + ["ip"]
    for (i, t), x, kind in zip(cases, hidden, kinds, strict=False):
        assert got[i].spans == f"{kind}:{t.index(x)}:{t.index(x) + len(x)}", (x, got[i].spans)
    assert [got[i].spans for i, _ in cases[len(hidden) :]] == [""] * len(sober)
    clean = {r.doc_id: r.text for r in redact_stage(every).where(f"doc_id >= {10**9}").collect()}
    assert all(clean[i] == f"the thing and [{k.upper()}] of the thing. Then more" for (i, _), k in zip(cases, kinds, strict=False))


def near_copies(rng, n, words, base=None):
    base = base or [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, words // 8)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**7)}"
        yield " ".join(w)


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, docs, k):
    rng = random.Random(5)
    rows = [(d.doc_id, d.text) for d in docs]
    rows += [(5000 + i, t) for i, t in enumerate(near_copies(rng, 150, 100))]
    rows += [(6000 + i, t) for i, t in enumerate(near_copies(rng, 40, 30))]
    rows += [(7000 + i, rows[3][1]) for i in range(20)]
    sets = {i: shingle_set(t, k) for i, t in rows}
    index, links = defaultdict(list), set()
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter(p for ids in index.values() for p in itertools.combinations(ids, 2))
    links = [p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = roots(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_minhash_slices(spark, monkeypatch):
    """A large cluster that is dealt to many slices gives the same links."""
    from loamwork.llm import minhash

    rng = random.Random(8)
    texts = [t for _ in range(2) for t in near_copies(rng, 120, 60)]
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t, 2) for i, t in rows}
    root = roots(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    whole = minhash.unsettled_pairs
    monkeypatch.setattr(minhash, "unsettled_pairs", lambda *a: whole(*a, slice_rows=7))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, pivots=1).collect()}
    assert got == root


def test_encoder(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(Q.byte_bpe())
    encode = Encoder(Q.byte_bpe(), cache=50)
    odd = ["", " ", "  a", "a  b", "a \n b", "a\n \nb", " \n", "it's  we'll", "x" * 2500 + " y", "ü 漢字🙂 <|endoftext|> z", "a   b", "tab\t \tend ", "1 22  333"]
    for t in [d.text for d in docs[:60]] + odd:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:60])


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 64) for _ in range(500))
    fill, seen = defaultdict(list), Counter()
    for length, rank, n, first, offset in best_fit(counts, 64):
        assert rank == seen[length]
        seen[length] += n
        for s in range(first, first + n):
            fill[s].append((offset, length))
    assert seen == counts
    for x in fill.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    gaps = []  # best fit, longest first, one piece at a time
    for k in sorted(counts.elements(), reverse=True):
        fits = [g for g in gaps if g >= k]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - k)
        else:
            gaps.append(64 - k)
    assert len(fill) == len(gaps)


def test_packing(spark, docs):
    got = defaultdict(list)
    seqs = defaultdict(list)
    for r in Q.op10_pack(spark, SMALL).collect():
        got[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    encode = Encoder(Q.byte_bpe())
    total = 0
    for d in docs:
        ids = np.append(np.frombuffer(encode(d.text or ""), "<u4"), 0).astype("<u4")
        total += len(ids)
        pieces = sorted(got[d.doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == 2048 for p in pieces[1:])
        assert sum(p.length for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    assert len(seqs) <= -(-total // 2048) + 1
    for s in seqs.values():
        assert sum(n for _, n in s) == max(o + n for o, n in s) <= 2048


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert kept.count() == docs.count()  # clean documents stay
    one = corpus_pipeline.STAGES[1][1](spark, docs, SMALL).collect()
    sets = {r.doc_id: shingle_set(r.text, 5) for r in docs.collect()}
    mine = [r.doc_id for r in one]
    for a, b in itertools.combinations(mine, 2):
        n = len(sets[a] & sets[b])
        assert 100 * n < 80 * (len(sets[a]) + len(sets[b]) - n)
    red = corpus_pipeline.STAGES[2][1](spark, docs, SMALL).collect()
    assert not any(list(base_spans(r.text)) for r in red)
