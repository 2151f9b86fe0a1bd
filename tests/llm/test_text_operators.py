"""Operators on texts against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from textmill.llm import decontamination, simhash
from textmill.llm import substring_dedup as substring
from textmill.llm.components import connected, label
from textmill.llm.decontamination import contamination, decontaminated, removal_spans
from textmill.llm.exact_dedup import deduplicated, exact_dedup
from textmill.llm.fm_index import FMIndex
from textmill.llm.line_dedup import dedup_document_lines, dedup_page_lines
from textmill.llm.recompression import recompress
from textmill.llm.sharding import GapTree, best_fit_decreasing, pack_evenly, shards
from textmill.llm.simhash import near_deduplicated, simhash_groups
from textmill.llm.substring_dedup import substring_dedup, without_repeats
from textmill.llm.words import U, mix

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def collected(df):
    return Counter(tuple(r) for r in df.collect())


# exact deduplication


def test_exact_dedup(docs, rows, nothing):
    norm = [SPACE.sub(" ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    want = Counter()
    for (i, _), t in zip(rows, norm, strict=True):
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collected(exact_dedup(docs)) == want
    assert exact_dedup(nothing).count() == 0
    assert deduplicated(docs).columns == docs.columns


# substring deduplication


def brute_substrings(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, float("inf")), float("inf") if i is None else i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (float("inf") if i is None else i):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("width", [13, 2])
def test_substring_dedup(docs, rows, nothing, width):
    assert collected(substring_dedup(docs, width)) == brute_substrings(rows, width)
    assert without_repeats(nothing, width).count() == 0


def passes(rows, width, n_chunks=5, n_buckets=3):
    """The passes of substring deduplication in this process: (result, bytes sent)."""
    rounds, rng = substring.rounds_for(width), random.Random(1)
    dealt = [[] for _ in range(n_chunks)]
    for r in rows:
        rng.choice(dealt).append(r)
    chunks = [pa.table({"doc_id": pa.array([i for i, _ in c], pa.int64()), "text": pa.array([t for _, t in c], pa.string())}) for c in dealt if c]
    named = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("answer", pa.binary())])
    told, sent = None, 0

    def by(table, *columns):
        places = defaultdict(list)
        for k, key in enumerate(zip(*(table[c].to_pylist() for c in columns), strict=True)):
            places[key].append(k)
        return [(tuple(map(pa.scalar, key)), table.take(pa.array(rng.sample(v, len(v))))) for key, v in places.items()]

    def each(f):
        if told is None:
            return pa.concat_tables([f((pa.scalar(k),), c) for k, c in enumerate(chunks)])
        return pa.concat_tables([f((pa.scalar(k),), c, told.filter(pc.equal(told["chunk"], k))) for k, c in enumerate(chunks)])

    for level in range(rounds + 1):
        asked = each(substring._ask(level, width, rounds, n_buckets))
        answers = [substring._tell_names(n_buckets)(*x).cast(named) for x in by(asked, "bucket", "level")]
        told = pa.concat_tables([named.empty_table() if told is None else told, *answers])
        sent += asked.nbytes + sum(x.nbytes for x in answers)
    sought = each(substring._seek(width, rounds, n_buckets))
    told = pa.concat_tables([named.empty_table(), *(substring._tell_windows(width, rounds + 1, n_buckets)(*x).cast(named) for x in by(sought, "bucket"))])
    out = each(substring._remove(width, rounds + 1))
    result = Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in zip(*(out[c].to_pylist() for c in out.column_names), strict=True))
    return result, sent + sought.nbytes + told.nbytes


def repeating_rows(n, seed=2):
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}_{j}" for j in range(rng.randint(10, 40))) for k in range(n // 8)]
    return [(rng.randint(0, 2 * n), " ".join(rng.choice([f"x{rng.randint(0, n)}", rng.choice(passages), "a a a a", "b"]) for _ in range(rng.randint(0, 20)))) for _ in range(n)]


@pytest.mark.parametrize("width", [2, 5, 13, 30])
@pytest.mark.parametrize("chunks", [1, 7])
def test_substring_passes(rows, width, chunks):
    for texts in (rows, repeating_rows(120), [(i, " ".join(random.Random(i).choice("abc") for _ in range(i))) for i in range(50)]):
        assert passes(texts, width, chunks)[0] == brute_substrings(texts, width)


def test_windows_whose_hashes_clash_are_told_apart(rows, monkeypatch):
    monkeypatch.setattr(substring, "window_hashes", lambda words, at, width: np.zeros(len(at), U))
    for texts in (rows, repeating_rows(100)):
        assert passes(texts, 13)[0] == brute_substrings(texts, 13)


def test_keys_that_clash_only_leave_more_to_verify(rows, monkeypatch):
    monkeypatch.setattr(substring, "KEY_BYTES", 1)
    assert passes(rows, 13)[0] == brute_substrings(rows, 13)


def test_what_substring_passes_send_grows_with_the_text():
    rng = random.Random(3)
    passages = [" ".join(f"p{k}_{j}" for j in range(30)) for k in range(60)]
    rows = [(i, " ".join(rng.choice([f"x{rng.randint(0, 2000)}", f"x{rng.randint(0, 50)}", rng.choice(passages)]) for _ in range(40))) for i in range(2400)]
    sent = [passes(rows[: 600 * n], 13, 4 * n, 2 * n)[1] for n in (1, 2, 4)]
    assert sent[1] < 2.3 * sent[0] and sent[2] < 4.8 * sent[0]


def test_equal_contexts_give_equal_symbols():
    rng = np.random.default_rng(0)
    names = mix(np.arange(30).astype(U) + U(7))
    for _ in range(60):
        v = rng.choice([2, 3, 20])
        core = rng.integers(0, v, 40)
        texts = [np.concatenate([rng.integers(0, v, rng.integers(0, 20)), core, rng.integers(0, v, rng.integers(0, 20))]) for _ in range(2)]
        for rounds in (1, 2, 3):
            parses = [recompress(names[t], np.zeros(len(t), int), rounds) for t in texts]
            there = {(int(n), int(s), int(e)) for n, s, e in zip(parses[1].names, parses[1].begin, parses[1].end, strict=True)}
            p = parses[0]
            for n, s, e, lo, hi in zip(p.names, p.begin, p.end, p.low, p.high, strict=True):
                if lo < 0 or hi > len(texts[0]):
                    continue
                seen = texts[0][lo:hi]
                for q in range(len(texts[1]) - len(seen) + 1):
                    if (texts[1][q : q + len(seen)] == seen).all():
                        assert (int(n), q + s - lo, q + e - lo) in there


# SimHash


def brute_print(t):
    w = [x.encode() for x in words(low(t))]
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def test_simhash(docs, rows, nothing):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    want = Counter((i, f"{prints[k]:016x}", min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows))
    assert collected(simhash_groups(docs)) == want
    assert simhash_groups(nothing).count() == 0
    kept = {r.doc_id for r in near_deduplicated(docs).select("doc_id").collect()}
    assert kept == {min(v) for v in least.values()} | {None}


def test_near_deduplicated_keeps_one_of_repeated_rows(spark):
    a, b, c = ("one two three four five", "six seven eight nine ten", "red green blue black white")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (5, a, "x"), (2, b, "x"), (2, c, "x"), (2, c, "x"), (3, b, "x"), (1, c, "x"), (7, "alone", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    assert collected(near_deduplicated(docs)) == Counter([(1, a, "x"), (2, b, "x"), (1, c, "x"), (7, "alone", "x"), (None, a, "x"), (None, a, "x")])
    assert near_deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("small", [1 << 14, 1])
def test_anchors_lose_no_link(small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_RUN", small)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 800, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for x in np.repeat(base[:200], 4)]
    fp = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    a, b = simhash.links_at(*simhash.anchors(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    keep = i != j
    found, want = label(a, b), label(fp[i[keep]], fp[j[keep]])
    assert (found[0] == want[0]).all() and (found[1] == want[1]).all()


def test_components_by_rounds(spark, monkeypatch):
    from textmill.llm import components

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 250), rng.integers(0, 400, 250)
    a, b = np.concatenate([a, np.arange(1000, 1060), np.full(50, 2000)]), np.concatenate([b, np.arange(1001, 1061), np.arange(2001, 2051)])
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a bigint, b bigint")
    nodes, roots = label(a[a != b], b[a != b])
    want = defaultdict(set)
    for n, r in zip(nodes.tolist(), roots.tolist(), strict=True):
        want[r].add(n)
    for most in (200_000, 20):
        monkeypatch.setattr(components, "LOCAL_LINKS", most)
        got = defaultdict(set)
        for r in connected(links).collect():
            got[r.root].add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# decontamination

BREAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(t, items, width):
    w = BREAK.findall(low(t))
    hit, found = [False] * len(w), set()
    for item, it in items:
        iw = BREAK.findall(low(it))
        if item is None or not iw:
            continue
        n = min(width, len(iw))
        windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit[k : k + n] = [True] * n
                found.add(str(item))
    return w, hit, sorted(found)


def items_of(rows):
    texts = [t for _, t in rows if t and len(BREAK.findall(t)) > 40]
    return [(1, " ".join(texts[0].split()[5:40])), (10, texts[1].upper()), (2, "one"), (3, "Two words"), (4, ""), (5, None), (None, "fox"), (1, texts[2][:200]), (7, "not there at all"), (8, "a a a a a a a a a a a a")]


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_decontamination(spark, docs, rows, nothing, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter()
    for i, t in rows:
        w, hit, found = brute_hits(t, items, 10)
        want[(i, len(w), sum(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), any(hit))] += 1
    assert collected(contamination(docs, bench)) == want
    assert contamination(nothing, bench).count() == 0
    assert not contamination(docs, bench.limit(0)).where("contaminated").count()
    cleaned = {r.doc_id: r.text for r in decontaminated(docs, bench).collect() if r.doc_id is not None}
    for i, t in rows:
        if i is not None and sum(r[0] == i for r in rows) == 1:
            w, hit, _ = brute_hits(t, items, 10)
            assert (cleaned[i] is None) == (t is None)
            assert BREAK.findall(low(cleaned[i])) == [x for x, h in zip(w, hit, strict=True) if not h]
            assert any(hit) or cleaned[i] == t
    spans = removal_spans(docs, bench).collect()
    assert all(a.end < b.begin for r in spans for a, b in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("items", [[], [(1, "no word of these occurs anywhere here at all")]])
def test_decontamination_holds_little(items):
    windows = decontamination.Windows([(str(i), t) for i, t in items], 10)
    read = []

    def batches():
        for _ in range(60):
            read.append(1)
            text = " ".join(f"w{k}" for k in range(50_000))
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["row", "text"])

    out = decontamination._search(windows, decontamination._rows_found)(batches())
    next(out)
    assert len(read) == 1
    assert sum(x.num_rows for x in out) == 59


def test_decontamination_shards_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 1 << 40)
    words = " ".join(f"v{k}" for k in range(12))
    windows = decontamination.Windows([("1", words)], 10)
    read = []

    def batches():
        for _ in range(80):
            read.append(1)
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x " * 200_000 + words])], ["row", "text"])

    out = decontamination._search(windows, decontamination._rows_found)(batches())
    assert next(out).column("spans").to_pylist() == [[{"begin": 200_000, "end": 200_012}]] and 1 < len(read) < 45


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontamination, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    windows = decontamination.Windows([("1", "a bb ccc")], 10)
    data = np.frombuffer(b"a bb ccc x bb ccc a bc ccc", np.uint8)
    starts, ends, _ = decontamination.find_words(data, np.array([0, len(data)]), decontamination.IS_BREAK)
    assert windows.numbers(data, starts, ends).tolist() == [1, 2, 3, 0, 2, 3, 1, 0, 3]
    with pytest.raises(ValueError):
        decontamination.Windows([("1", "a b")], 10)


def test_fm_index():
    rng = np.random.default_rng(1)
    for n, s in ((1, 1), (5, 2), (200, 3), (2000, 40), (900, 1)):
        text = rng.integers(1, s + 1, n)
        full, index = text.tolist(), FMIndex(text)
        patterns = [[int(x) for x in rng.integers(1, s + 2, rng.integers(1, 6))] for _ in range(40)]
        padded, sizes = np.zeros((40, 6), int), np.array([len(p) for p in patterns])
        for k, p in enumerate(patterns):
            padded[k, : len(p)] = p
        lo, hi = index.search(padded, sizes)
        for k, p in enumerate(patterns):
            got = sorted(index.locate(np.arange(lo[k], max(lo[k], hi[k]))).tolist())
            assert got == [j for j in range(n) if full[j : j + len(p)] == p]


# line deduplication


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_line_dedup_of_documents(spark, nothing, broadcast, monkeypatch):
    from textmill.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST_MARKS", broadcast)
    rows = [(k, f"menu\nown {k}\n\nmenu\n" + ("rare\n" if k < 2 else "") + "x", "a", 1) for k in range(20)] + [(50 + k, "menu\nfew", "b", 1) for k in range(3)]
    rows += [(90, None, "a", 1), (91, "menu", None, 1), (92, "", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, host int")
    got = {r.doc_id: r.text for r in dedup_document_lines(docs, ratio=0.5, min_pages=3).collect()}
    assert got[0] == "own 0\n\nrare" and got[5] == "own 5\n" and got[50] == "" and got[90] is None and got[91] == "menu" and got[92] == ""
    assert dedup_document_lines(docs, 0.5, 3).columns == docs.columns
    assert {r.doc_id: r.text for r in dedup_document_lines(docs, 0.5, 4).collect()}[51] == "menu\nfew"
    assert dedup_document_lines(nothing).count() == 0


def test_line_dedup_of_pages(spark):
    html = "<title>T{0}</title><script>var a='<p>';</script><nav>Home</nav><p>body <b>{0}</b></p><!-- x --><footer>legal</footer>"
    pages = spark.createDataFrame([(k, "http://u@H.example:80/x", html.format(k)) for k in range(12)] + [(20, "no url", "<p>Home"), (21, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in dedup_page_lines(pages).collect()}
    assert got[3].host == "h.example" and got[3].text == "T3\nbody 3" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[20].text == "Home" and got[20].host is None and got[21].text == ""


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11])
def test_line_dedup_of_small_hosts(spark, n):
    rows = [(k, f"http://h{n}.example/{k}", f"<p>all</p><p>own {k}</p>" + "<p>pair</p>" * (k < 2) + "<p>one</p>" * (k == 0)) for k in range(n)]
    got = {r.page_id: r.text.split("\n") for r in dedup_page_lines(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(n):
        on = {"all": n, f"own {k}": 1, **({"pair": min(n, 2)} if k < 2 else {}), **({"one": 1} if k == 0 else {})}
        assert got[k] == [line for line, m in on.items() if not (m >= 2 and m / n > 0.1)]


def brute_pages(rows, ratio=0.1):
    lines = [[x for x in re.split(r"</?p>", h or "") if x] for _, _, h in rows]
    hosts = [re.match(r"http://([^/]+)/", u or "") for _, u, _ in rows]
    hosts = [h and h.group(1) for h in hosts]
    total, seen = Counter(hosts), Counter((h, x) for h, ls in zip(hosts, lines, strict=True) for x in set(ls))
    out = Counter()
    for (i, _, _), h, ls in zip(rows, hosts, lines, strict=True):
        kept = [x for x in ls if h is None or seen[h, x] < 2 or seen[h, x] / total[h] <= ratio]
        out[(i, h, len(ls), len(ls) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("most", [100_000, -1])
def test_line_dedup_of_pages_of_all_kinds(spark, most, monkeypatch):
    from textmill.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST_HOSTS", most)
    rng = np.random.default_rng(0)
    rows = [(k, f"http://h{rng.integers(0, 6)}.example/x", "".join(f"<p>line {int(x)}</p>" for x in rng.geometric(0.08, 8))) for k in range(150)]
    rows += [rows[3], rows[3], (None, rows[4][1], "<p>line 1</p>"), (900, None, "<p>line 1</p>"), (901, "http://h1.example/", None), (902, "http://h1.example/", ""), (903, "http://h2.example/", "".join(f"<p>long {k}</p>" for k in range(20000)))]
    pages = spark.createDataFrame([(*r, 1, "m", 2, "k") for r in rows], "page_id bigint, url string, html string, host int, marks string, n int, lines string")
    assert collected(dedup_page_lines(pages.repartition(7))) == brute_pages(rows)
    assert dedup_page_lines(pages.limit(0)).count() == 0


# sharding


def test_best_fit_decreasing_takes_the_tightest_gap():
    tree = GapTree()
    for k in [(5, 1), (3, 2), (9, 3), (5, 0)]:
        tree.add(k)
    assert tree.tightest(4) == (5, 0) and tree.tightest(10) is None
    tree.remove((5, 0))
    assert tree.tightest(4) == (5, 1)
    counts = [(7, 1), (5, 2), (3, 3), (2, 1)]
    bins = []
    for size in sorted((w for w, n in counts for _ in range(n)), reverse=True):  # one item at a time
        fits = [(10 - sum(b), k) for k, b in enumerate(bins) if 10 - sum(b) >= size]
        bins[min(fits)[1]].append(size) if fits else bins.append([size])
    plan = defaultdict(list)
    for w, b, n in best_fit_decreasing(counts, 10):
        plan[b] += [w] * n
    assert sorted(map(sorted, plan.values())) == sorted(map(sorted, bins))


def test_pack_evenly_gives_a_giant_its_own_shard():
    loads = Counter()
    for w, s, n in pack_evenly([(1000, 1), (10, 60), (3, 7)], 4):
        loads[s] += w * n
    assert sorted(loads.values())[-1] == 1000 and max(sorted(loads.values())[:3]) - min(loads.values()) <= 10 and sum(loads.values()) == 1621


def test_shards(docs, rows, nothing):
    got = shards(docs, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    by_text = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        by_text[(r.size, r.text_crc32)].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in by_text.values())
    assert shards(nothing, 4).count() == 0


def test_lookup_of_a_hot_key(spark):
    from textmill.llm.common import lookup

    rows = spark.range(3000).select(F.when(F.col("id") < 2900, 0).otherwise(F.col("id")).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = lookup(rows, found, ["k"], "n", 3000, "id").collect()
    assert len(out) == 3000 and all(r.least == (0 if r.k == 0 else r.id) for r in out)


def test_vector_hash_is_xxh64():
    from textmill.llm.words import xxh64

    raw = bytes(range(256)) * 2
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(150)
    ends = starts + np.arange(150)
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends, strict=True)]
    assert pa.array([1]).to_pylist() == [1]
