"""Operators on whole corpora: line dedup, near-dedup, decontamination, packing, the pipeline."""

import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import components, cuckoo, decontamination, golay, line_dedup, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("fp", "row", "h1", "key", "line", "pos", "n", "pack", "v")


def docs(spark, rows):
    """(doc_id, text) rows as documents, with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in EXTRA})


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [(1, "x")]).where("false")


# line dedup


def lines_by_hand(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((str(i), len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out)


LINES = ["A common line here", " a COMMON line here\t", "short", "", "Another repeated line", "ñandú ÑANDÚ ñandú", "ÑANDÚ ñandú ÑANDÚ"]


@pytest.mark.parametrize("limit", [line_dedup.MAX_FILTER_BYTES, 0])
def test_line_dedup_by_hand(spark, none, limit):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice([*LINES, f"only in document {i}"]) for _ in range(r.randint(0, 6)))) for i in range(40)]
    rows += [(3, "A common line here\nextra row of id three"), (None, "A common line here"), (50, None), (51, ""), (52, "\n\n"), (53, "long line " * 20_000 + "\nA common line here"), (3, rows[3][1])]
    got = line_dedup.dedup_lines(docs(spark, rows), max_filter_bytes=limit, extra=("source",)).collect()
    assert sorted((str(x["doc_id"]), x["n_lines"], x["n_dropped"], x["kept"]) for x in got) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(tuple, c.sql(line_dedup.OP5_SQL).fetchall()))
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.op5_line_dedup(spark, sf).collect()) == want


def test_line_state_is_reversible(spark):
    first = [(1, "A common line here\nOnly first has this"), (2, "A common line here\nAnother repeated line")]
    second = [(3, "Another repeated line\nA COMMON line here"), (0, "A common line here")]
    s = line_dedup.LineDedupState(spark, n_shards=3)
    see = lambda: (sorted(tuple(r) for r in s.ref_counts().collect()), sorted(tuple(r) for r in s.drops().collect()))
    s.insert(docs(spark, first))
    before = see()
    assert len(before[1]) == 1 and before[1][0][0] == 2
    s.insert(docs(spark, second))
    assert sorted(r[0] for r in see()[1]) == [1, 2, 3, 3]
    s.delete(spark.createDataFrame([(3,), (0,), (99,)], "doc_id long"))
    assert see() == before
    keys = s.postings().select("h1", "h2").distinct()
    assert s.unseen(keys).count() == 0
    again = line_dedup.LineDedupState(spark, s.path, n_shards=3)
    assert again.version == s.version and sorted(tuple(r) for r in again.drops().collect()) == before[1]
    s.insert(docs(spark, [(1, "A common line here\nA line that came later")]))
    assert s.postings().where("doc_id = 1").count() == 3
    s.delete(spark.createDataFrame([(1,), (None,)], "doc_id long"))
    s.insert(docs(spark, first[:1]))  # what went may come again
    assert see() == before
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(s.path.removeprefix("file://") + f"/postings/{s.version}") for f in fs]
    assert sizes and s.postings().count() == 4
    s.compact(5)
    assert see() == before and s.first == s.version and s.n_shards == 5 and s.unseen(keys).count() == 0
    third = line_dedup.LineDedupState(spark, s.path)
    assert third.n_shards == 5 and sorted(tuple(r) for r in third.drops().collect()) == before[1]
    s.delete(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert see() == ([], []) and s.unseen(keys).count() == keys.count() == 3
    for r in s.filters().collect():
        assert not cuckoo.CuckooFilter.from_bytes(bytes(r["bytes"])).cells.any()


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 6000))
    f = cuckoo.CuckooFilter.of(a[:4000], b[:4000])
    assert f.contains(a[:4000], b[:4000]).all() and f.contains(a[4000:], b[4000:]).mean() < 0.01
    g = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    g.delete(a[:2000], b[:2000])
    assert g.contains(a[2000:4000], b[2000:4000]).all() and g.contains(a[:2000], b[:2000]).mean() < 0.05
    assert not cuckoo.CuckooFilter(8).insert(a, b)
    whole = cuckoo.CuckooFilter.of(a, b)
    assert (whole.cells != 0).sum() == len(a) and whole.contains(a, b).all()
    same = np.full(6, a[0]), np.full(6, b[0])
    assert cuckoo.CuckooFilter.of(*same).contains(*same).all()


def test_probe_by_shard_deals_hot_lines(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 0, 0, int(h1), int(h2)) for k, (h1, h2) in enumerate(rng.integers(-(2**63), 2**63 - 1, (300, 2)))] + [(1000 + k, 0, k, 5, 7 << 20) for k in range(400)]
    keys = spark.createDataFrame(rows, "doc_id long, row long, pos int, h1 long, h2 long")
    held = spark.createDataFrame([r[3:] for r in rows[:100]] + [(5, 7 << 20)], "h1 long, h2 long")
    filters = line_dedup.shard_filters(held, 4)
    want = {r[:3] for r in [*rows[:100], *rows[300:]]}
    for got in (line_dedup.joined_probe(keys, filters, 4, 50), line_dedup.sent_probe(keys, filters, 4)):
        found = {tuple(r)[:3] for r in got.collect()}
        assert want <= found and len(found) < len(want) + 10


# near-dedup


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, step=97)
    index = golay.decode(words)
    assert index.max() < 4096
    syn, leader, _ = golay.tables()
    assert (leader >= 0).all() and max(int(x).bit_count() for x in leader) == 3
    near, count = golay.decode_near(words[:3000], 23)
    for w, k, n in zip(words[:300].tolist(), near, count, strict=False):
        assert set(k[:n].tolist()) == {int(golay.decode(np.array([w ^ e]))[0]) for e in [0, *(1 << i for i in range(23))]}


def test_keys_lose_no_link():
    rng = np.random.default_rng(1)
    for _ in range(600):
        a = rng.integers(0, 2**64, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        who, key, side = simhash.key_table(np.array([a, b], np.uint64).view(np.int64))
        mine = {k for w, k, s in zip(who.view(np.uint64), key, side, strict=True) if w == a and s != 1}
        theirs = {k for w, k, s in zip(who.view(np.uint64), key, side, strict=True) if w == b and s != 0}
        assert mine & theirs or a == b


def fp_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_fingerprints_at_once_are_the_single_ones(monkeypatch):
    r = random.Random(12)
    texts = ["".join(r.choice("aB É\n\t\x0b\x1c漢 ") for _ in range(r.randint(0, 300))) for _ in range(300)]
    texts += [None, "", " \n", "a", "a b", "  A  B c\td\re  ", "\xa0 \x85", *(" ".join("w" * r.randint(1, 70) for _ in range(r.randint(1, 80))) for _ in range(100))]
    want = [fp_by_hand(t) for t in texts]
    assert simhash.fingerprint_batch(texts).tolist() == want and simhash.fingerprint_batch([]).tolist() == []
    big = ["x y " * 40_000, "q" * (1 << 20) + " r", "k" * 70_000 + " b c d e", "a b c " * 3_000]
    assert simhash.fingerprint_batch(big).tolist() == [simhash.fingerprint(t) for t in big]
    for size, seed in ((1, 42), (9, 0), (4, (1 << 64) - 1)):
        assert simhash.fingerprint_batch(texts, size, seed).tolist() == [simhash.fingerprint(t, size, seed) for t in texts]
    monkeypatch.setattr(simhash, "PORTION", 200)
    assert simhash.fingerprint_batch(texts).tolist() == want


def test_near_duplicates_by_hand(spark, none):
    r = random.Random(2)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randint(0, 99)) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(10, 60):
        w = base[i % 6].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(70, base[0].upper()), (71, None), (72, ""), (73, " \n\t"), (74, "one"), (75, "ONE"), (None, base[0]), (3, base[3]), (1, base[2]), (76, "x " * 150_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = sorted((str(i), fp_by_hand(t)) for i, t in rows)
    assert sorted((str(x["doc_id"]), x["fp"] % (1 << 64)) for x in got) == fps
    ids = [(i, f) for i, f in ((i, fp_by_hand(t)) for i, t in rows) if i is not None]
    nodes = sorted({f for _, f in ids})
    group = {f: {f} for f in nodes}
    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    least = {f: min(i for i, g in ids if g in group[f]) for f in nodes}
    want = sorted((str(i), str(least[fp_by_hand(t)]) if i is not None else "None") for i, t in rows)
    assert sorted((str(x["doc_id"]), str(x["component_id"])) for x in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[k] == 7 for k in range(200, 260))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def leaks_by_hand(rows, items, similarity=0.8):
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for item, text in items:
        iw = words(text)
        if not iw or item is None:
            continue
        k = min(5, len(iw))
        ig = collections.Counter(grams(iw, k))
        m = sum(ig.values())
        for doc, t in rows:
            g = grams(words(t), k)
            n = min(m, len(g))
            for s in range(len(g) - n + 1 if n else 0):
                both = sum((collections.Counter(g[s : s + n]) & ig).values())
                j = both / (m + n - both)
                if j >= similarity - 1e-12 and doc is not None and j > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (j, s)
    return out


def test_decontamination_by_hand(spark, none):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 45, 12, 60, 5, 9])] + [(20, "two words"), (21, None), (22, ""), (None, text(20)), (23, "rep " * 20), (24, "Ünïcode straße 漢字 text, with five")]
    rows = []
    for d in range(60):
        i, it = r.choice(items[:6])
        w = it.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edited"
        if r.random() < 0.2:
            w = w[: int(len(w) * r.uniform(0.7, 1))]
        rows.append((d, f"{text(r.randint(0, 20)).upper()} {', '.join(w)}. {text(r.randint(0, 20))}"))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, "here are TWO words, again"), (103, items[0][1]), (103, items[1][1]), (103, items[1][1]), (104, "rep " * 300), (105, text(3)), (106, text(30_000) + " " + items[3][1]), (107, "x ünïcode STRASSE straße 漢字 text with five y"), (108, items[4][1])]
    got = {(x["doc_id"], x["item_id"]): (x["similarity"], x["start"]) for x in decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit(1))).collect()}
    want = leaks_by_hand([x for x in rows if x[0] != 106], items)
    long = {k: v for k, v in got.items() if k[0] == 106}
    assert (106, 3) in long
    got = {k: v for k, v in got.items() if k[0] != 106}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert any(0.8 <= v[0] < 0.95 for v in want.values())
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontamination.decontaminate(docs(spark, rows), bench)
    bad = {d for d, _ in want} | {106}
    assert sorted(str(x["doc_id"]) for x in left.collect()) == sorted(str(i) for i, _ in rows if i not in bad)
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs(spark, rows), bench.where("false")).count() == 0


def test_decontamination_runs_no_python(spark, sf, monkeypatch):
    plans, keep = [], decontamination.keep

    def seen(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, what)

    monkeypatch.setattr(decontamination, "keep", seen)
    plans.append(decontamination.op6_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_blocks_find_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63 - 1, 200)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False)) for _ in a]
    pairs = spark.createDataFrame([(int(x), int(np.int64(np.uint64(int(x) % (1 << 64)) ^ np.uint64(f)))) for x, f in zip(a, flips, strict=True)], "a long, b long")
    both = pairs.select(F.arrays_overlap(decontamination.blocks("a", 23), decontamination.blocks("b", 23)).alias("hit"))
    assert both.where("hit").count() == 200


def test_anchors_agree_without_broadcast(spark, monkeypatch, sf):
    a = sorted(map(tuple, decontamination.op6_decontamination(spark, sf).collect()))
    monkeypatch.setattr(decontamination, "MAX_SHINGLES", -1)
    monkeypatch.setattr(decontamination, "MAX_SENT", -1)
    assert sorted(map(tuple, decontamination.op6_decontamination(spark, sf).collect())) == a and a


# packing


def pack_by_hand(pieces, capacity, per_source):
    bins = []
    for size, source, cluster in pieces:
        fits = [b for b in bins if b["free"] >= size and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"][source] < per_source)]
        if fits:
            b = min(fits, key=lambda b: (b["free"], b["k"]))
        else:
            b = {"k": len(bins), "free": capacity, "clusters": set(), "sources": collections.Counter()}
            bins.append(b)
        b["free"] -= size
        b["clusters"].add(cluster)
        b["sources"][source] += 1
        yield b["k"]


def test_packer_is_exact_best_fit():
    r = random.Random(4)
    for _ in range(30):
        pieces = [(r.randint(0, 50), r.choice("abc") if r.random() < 0.9 else None, r.choice([None, *range(8)])) for _ in range(150)]
        p = packing.Packer(60, 2)
        assert [p.add(*x) for x in pieces] == list(pack_by_hand(pieces, 60, 2))


def test_packing_keeps_every_token(spark, none):
    r = random.Random(5)
    rows = [(i, "w" * r.randint(0, 900)) for i in range(200)] + [(7, "again"), (None, "no id"), (None, None), (300, "y" * 50_000), (301, None), (302, "")] + [(400 + k, "copy of one text") for k in range(30)]
    df = docs(spark, rows)
    got = packing.pack_documents(df, capacity=100, per_source=3, pack_tokens=4_000).collect()
    size = lambda t: -(-len((t or "").encode()) // 4)
    by = collections.defaultdict(int)
    for x in got:
        by[x["doc_id"]] += x["n_tokens"]
    want = collections.defaultdict(int)
    for i, t in rows:
        want[i] += size(t)
    assert by == want
    bins = collections.defaultdict(list)
    for x in got:
        bins[x["bin"]].append(x)
    source = {i: f"s{(i or 0) % 3}" for i, _ in rows}
    for b in bins.values():
        assert sum(x["n_tokens"] for x in b) == b[0]["fill"] <= 100 and sorted(x["place"] for x in b) == list(range(len(b)))
        assert max(collections.Counter(source[x["doc_id"]] for x in b).values()) <= 3
        assert sum((x["doc_id"] or 0) >= 400 for x in b) <= 1
    assert len({x["bin"] >> 32 for x in got}) > 1
    assert sorted((x["piece"], x["start"]) for x in got if x["doc_id"] == 300) == [(k, 100 * k) for k in range(125)]
    assert packing.pack_documents(none).count() == 0
    again = packing.pack_documents(df, capacity=100, per_source=3, pack_tokens=4_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing_by_tokens_and_near_duplicates(spark, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(6)
    words = ["señor", "über", "naïve", "xqz", "the", "Straße", "ñandú"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(150)]
    base = [f"{r.choice(words)}{k}" for k in range(400)]
    group = [(500 + k, " ".join([*base[:399], f"tail{k}"])) for k in range(8)]  # near copies
    cased = [(600, "école ñandú"), (601, "ÉCOLE  ÑANDÚ"), (602, "École Ñandú ")]
    rows += [*group, *cased, (7, "again"), (None, None), (None, "no id"), (300, "ñ über " * 3_000), (301, "")]
    got = packing.pack_tokenized(docs(spark, rows), path, capacity=2500, per_source=50).collect()
    t = Tokenizer.from_file(path)
    want, by = collections.Counter(), collections.Counter()
    for i, x in rows:
        want[i] += len(t.encode(x or "", add_special_tokens=False).ids)
    for x in got:
        by[x["doc_id"]] += x["n_tokens"]
    assert by == want
    assert len({x["bin"] for x in got if (x["doc_id"] or 0) >= 600}) == 3
    bins = collections.defaultdict(list)
    for x in got:
        bins[x["bin"]].append(x)
    fps = {i: fp_by_hand(x) for i, x in group}
    roots = {i: min(j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
    assert len(set(fps.values())) > 1 and len(set(roots.values())) < len(fps)
    for b in bins.values():
        assert sum(x["n_tokens"] for x in b) == b[0]["fill"] <= 2500
        near = [roots[x["doc_id"]] for x in b if x["doc_id"] in roots]
        assert len(near) == len(set(near))
    assert packing.pack_tokenized(none, path).count() == 0


def test_packing_keeps_large_ids_beside_null_ones(spark):
    rows = [((1 << 60) + 1, "a"), (None, "b"), ((1 << 60) + 3, "c"), (None, "b"), (None, "b")]
    got = packing.pack_documents(docs(spark, rows)).collect()
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(i) for i, _ in rows)


def test_packing_deals_equal_rows_without_id_apart(spark):
    same = spark.range(0, 3_000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("words " * 40).alias("text"), F.lit(None).cast("string").alias("source"))
    got = packing.pack_documents(same, pack_tokens=20_000).groupBy(F.shiftright("bin", 32)).count().collect()
    assert len(got) == 9 and max(r["count"] for r in got) < 600 and sum(r["count"] for r in got) == 3_000


def test_rows_without_id_are_numbered_alike_when_a_task_runs_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    rows = [(None, n, s, c) for n, s, c, k in ((5, "a", "x", 16), (5, None, "x", 7), (0, None, None, 1)) for _ in range(k)]
    table = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster string")
    got = sorted(map(tuple, packing.counted_out(table.repartition(5)).collect()), key=str)
    assert got == sorted(((None, n, s, c, i) for n, s, c, k in ((5, "a", "x", 16), (5, None, "x", 7), (0, None, None, 1)) for i in range(k)), key=str)
    assert got == sorted(map(tuple, packing.counted_out(table.repartition(3, "source")).collect()), key=str)
    assert packing.counted_out(table.limit(0)).count() == 0


def test_extra_columns_may_have_any_name(spark):
    line = "a line that both documents hold"
    names = ["lines", "gone", "row", "fp", "component_id", "kept", "n_lines", "text", "root", "first", "a.b"]
    rows = spark.createDataFrame([(1, line, *[f"{c}1" for c in names if c != "text"]), (2, line + "\nand one more", *[f"{c}2" for c in names if c != "text"])], ["doc_id", "text", *[c for c in names if c != "text"]])
    got = {r["doc_id"]: r.asDict() for r in line_dedup.dedup_lines(rows, extra=tuple(names)).collect()}
    assert got[2]["kept"] == "and one more" and got[2]["n_lines"] == 2 and got[2]["text"] == line + "\nand one more"
    assert all(got[i][c] == f"{c}{i}" for i in (1, 2) for c in ("lines", "gone", "row", "fp", "component_id", "root", "first", "a.b"))
    got = {r["doc_id"]: r.asDict() for r in simhash.near_duplicates(rows, extra=tuple(names)).collect()}
    assert got[1]["component_id"] == 1 and isinstance(got[2]["fp"], int) and all(got[i][c] == f"{c}{i}" for i in (1, 2) for c in ("lines", "gone", "row", "kept", "n_lines", "root", "first", "a.b"))
    assert got[1]["text"] == line


# pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp
    from gridloom.llm.quality import fit_quality, measured, score_quality

    sf = "/root/testdata/sf0.01"
    start = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in start.collect()}
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near", "leaks", "pack"]

    def step(k, df):
        out = cp.STAGES[k][1](spark, df, sf)
        assert k == 4 or out.columns == start.columns
        return spark.createDataFrame(out.collect(), out.schema)

    one = step(0, start)
    model, _ = fit_quality(measured(start), spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in score_quality(start, model).where("score >= 0.3").collect()}
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {i: t for i, t in rows.items() if i in good}
    two = step(1, one)
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    assert {str(i): t for i, t in texts.items()} == {i: t for i, _, _, t in lines_by_hand([(i, rows[i]) for i in sorted(good)])}
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = step(2, two)
    fps = {i: fp_by_hand(t) for i, t in texts.items()}
    left, kept = set(fps), []
    for i in sorted(fps):
        if i in left:
            kept.append(i)
            todo = [i]
            while todo:
                f = fps[todo.pop()]
                near = [j for j in left if (fps[j] ^ f).bit_count() <= 4]
                left -= set(near)
                todo += near
    assert sorted(r["doc_id"] for r in three.collect()) == kept
    four = step(3, three)
    flat = lambda t: " ".join(w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w)
    held = [i for i in kept if any(f" {flat(b)} " in f" {flat(texts[i])} " for _, b in bench)]
    stay = {r["doc_id"] for r in four.collect()}
    assert held and not stay & set(held) and set(kept) - stay >= set(held) and len(set(kept) - stay) <= len(held) + 3
    five = step(4, four)
    assert {r["doc_id"] for r in five.collect()} == stay
    assert cp.run(spark, sf).count() == five.count()


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, "Some plain words here", "en", "a", 1), (None, "A row without an id", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (3, "the same id again", "en", "a", 0)]
    for name, data in (("a", rows), ("b", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, DOCS).withColumn("fp", F.lit(1)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "an item of the benchmark with enough words")] if data else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = sorted((str(r["doc_id"]), r["start"]) for r in cp.run(spark, d).collect())
        # 3 with an empty text is a copy of 2 and goes; 3 with a text of its own stays
        assert got == ([("1", 0), ("2", 0), ("3", 0), ("None", 0)] if data else [])
    kept = cp.near(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == [("1", "Some plain words here"), ("2", ""), ("3", "the same id again"), ("None", "A row without an id")]
