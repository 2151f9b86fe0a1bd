"""Packing by exact round trip, classifiers by held-out accuracy, conversations by brute force, the pipeline by stages."""

import itertools
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

import corpus_pipeline
from textmill.llm import packing, quality, registry, toxicity
from textmill.llm.packing import pack, plan, sequences
from textmill.llm.quotation import link_quotations, parse
from textmill.llm.words import text_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pack_round_trip(docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    placed = pack(docs, PATH, 64).cache()
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(i, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in placed.collect()) == want
    filled = defaultdict(list)
    for r in placed.collect():
        filled[r.sequence_id].append((r.offset, r.length, r.ids_crc32))
    for parts in filled.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= 1.1 * sum(k[3] * n for k, n in want.items()) / 64 + 1
    known = placed.where("doc_id is not null")
    for r in sequences(docs.where("doc_id is not null"), known, PATH, 64).collect():
        for offset, length, crc in filled[r.sequence_id]:
            if len(r.ids) == sum(p[1] for p in filled[r.sequence_id]):
                assert zlib.crc32(np.array(r.ids[offset : offset + length], "<u4").tobytes()) == crc
    assert pack(nothing, PATH).count() == 0


@pytest.mark.parametrize("capacity", [10, 50, 2048])
def test_plan_places_every_piece_once(capacity):
    rng = np.random.default_rng(capacity)
    for most in (1, 5, 300, 2000):
        counts = Counter(rng.integers(1, capacity + 1, most).tolist())
        by_length, sequence = defaultdict(list), defaultdict(list)
        for length, rank, n, base, offset in plan(counts, capacity):
            by_length[length].append((rank, n))
            for k in range(n):
                sequence[base + k].append((offset, length))
        for length, n in counts.items():
            at = 0
            for rank, m in sorted(by_length[length]):
                assert rank == at
                at += m
            assert at == n
        for parts in sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity and sum(3 * x > capacity for _, x in parts) <= 2


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(10):
        first = np.concatenate([[0], np.cumsum(rng.integers(1, 5, 4))])
        odds, stick = rng.normal(size=first[-1]), rng.normal()
        good, agree = quality.marginals(odds, stick, first)
        for d in range(4):
            o = odds[first[d] : first[d + 1]]
            n, z = len(o), 0.0
            g, a = np.zeros(n), np.zeros(n)
            for y in itertools.product([0, 1], repeat=n):
                p = np.exp(sum(o * y) + sum(stick if y[i] == y[i - 1] else -stick for i in range(1, n)))
                z, g = z + p, g + p * np.array(y)
                a[1:] += [p * (y[i] == y[i - 1]) for i in range(1, n)]
            assert np.allclose(g / z, good[first[d] : first[d + 1]]) and np.allclose(a / z, agree[first[d] : first[d + 1]])


def test_edge_rows_of_classifiers(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, (i or 0) % 2, (i or 0) % 2) for i, _ in rows] + [(1, None, None), (2, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    for op, mod, kept in ((quality.quality, 5, 0), (toxicity.toxicity, 3, 1)):
        for table in (labels, labels.limit(0)):
            out = op(docs, table).collect()
            assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
            assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % mod == kept) for r in out)
        assert op(nothing, labels).count() == 0


@pytest.mark.parametrize(("name", "column", "bound", "recall", "false"), [("op10_quality", "quality", 0.3, 0.99, 0.1), ("op8_toxicity", "toxic", 0.7, 0.8, 0.02)])
def test_held_out_accuracy(spark, name, column, bound, recall, false):
    sf = str(DATA / "sf0.1")
    scored = registry.QUERIES[name](spark, sf).where("held_out")
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(column, "score", "predicted").collect()
    assert all(r.predicted == int(r.score >= bound) for r in rows)
    one, zero = [r.predicted for r in rows if r[column] == 1], [r.predicted for r in rows if r[column] == 0]
    assert len(one) > 50 and len(zero) > 50
    assert np.mean(one) >= recall and np.mean(zero) <= false


class BruteKneserNey:
    """One class's model in plain Python: modified Kneser-Ney of documents as contexts, over a shared distribution."""

    def __init__(self, texts, shared):
        self.shared = shared
        docs = [t.split() for t in dict.fromkeys(texts)]
        self.words = Counter(w for d in docs for w in set(d))
        self.pairs = Counter(p for d in docs for p in set(zip(["<>", *d], d)))
        self.word_loss, self.pair_loss = self.losses(self.words), self.losses(self.pairs)

    @staticmethod
    def losses(counts):
        n = Counter(counts.values())
        out = {k: 0.75 * k for k in (1, 2, 3)}
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for k in (1, 2, 3):
                d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0
                if 0 < d < k:
                    out[k] = d
        return out

    def word(self, w):
        total = sum(self.words.values())
        left = sum(self.word_loss[min(c, 3)] for c in self.words.values()) / total
        c = self.words[w]
        return (c - self.word_loss[min(c, 3)] if c else 0) / total + left * self.shared(w)

    def pair(self, v, w):
        of = {p: c for p, c in self.pairs.items() if p[0] == v}
        if not of:
            return self.word(w)
        total, c = sum(of.values()), self.pairs[v, w]
        left = sum(self.pair_loss[min(x, 3)] for x in of.values()) / total
        return (c - self.pair_loss[min(c, 3)] if c else 0) / total + left * self.word(w)


def test_toxicity_is_kneser_ney(spark):
    rng = np.random.default_rng(4)
    text = lambda n, extra=(): " ".join([*(f"w{int(x)}" for x in rng.zipf(1.6, n) % 60), *extra])
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, text(rng.integers(2, 30), ["vile", f"w{i % 9}", "scum"][: i % 4] if i % 2 else ())) for i in learn]
    rows[10], rows[14] = (rows[10][0], rows[12][1]), (rows[14][0], rows[12][1])  # copies count once
    rows += [(1000 + i, f"new{i} other{i % 50} w1 w1") for i in range(200)] + [(None, "w2 lone"), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in learn], "doc_id bigint, toxic int")
    models = toxicity.fit(docs, labels)
    seen = Counter(w for _, t in rows for w in set((t or "").split()))
    mass = sum(seen.values()) + len(seen) + 1
    sample = toxicity.training_sample(docs, labels, "toxic", F.lit(True), toxicity.PER_CLASS).to_pydict()
    number, counted = Counter(), {0: [], 1: []}
    for t, k in zip(sample["text"], sample["label"], strict=True):
        if number[k] % 3 < 2:
            counted[k].append(t)
        number[k] += 1
    toxic, ordinary = (BruteKneserNey(counted[k], lambda w: (seen[w] + 1) / mass) for k in (1, 0))
    for words in ["vile scum w1 w2", "w1 w1 w3 unheard w5 vile", "scum", "other3 new4 w1"]:
        d = words.split()
        alone, after, first = models.differences(*text_bytes(pa.array([words])))
        assert first.tolist() == [0, len(d)]
        # words that neither class has: only the classes' backoffs differ, whatever the word
        assert np.allclose(alone, [np.log(toxic.word(w) / ordinary.word(w)) for w in d], atol=1e-9, rtol=0)
        assert np.allclose(after, [np.log(toxic.pair(v, w) / ordinary.pair(v, w)) for v, w in zip(["<>", *d], d, strict=False)], atol=1e-9, rtol=0)
    for model in (toxic, ordinary):  # probabilities: all words of the corpus, and one share of 1 / mass for the unheard
        assert np.isclose(sum(model.word(w) for w in seen) + model.word("unheard"), 1)


def test_toxicity_learns_from_all_labelled_documents(spark):
    """More documents of either class than a sample has; each has a word of its own, and what is looked up by bounds gives the plain scores."""
    rng = random.Random(3)
    learn = [i for i in range(12000) if zlib.crc32(str(i).encode()) % 3 != 1][:7200]
    toxic = {i: int(k % 3 == 0) for k, i in enumerate(learn)}  # 2,400 and 4,800
    text = lambda i: " ".join([f"own{i}", *(f"w{rng.randrange(40)}" for _ in range(8)), *(["vile", f"scum{i % 50}"] if toxic.get(i) and i % 4 else [])])
    rows = [(i, text(i)) for i in learn] + [(20000 + i, f"vile scum{i} w{i} own{learn[i]} w3 unheard{i}") for i in range(60)] + [(None, None), (3, ""), (30000, "vile " * 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    models = toxicity.fit(docs, spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int"))
    alone, _, _ = models.differences(*text_bytes(pa.array([" ".join(f"own{i}" for i in learn)])))
    for label, n in ((1, 1600), (0, 3200)):  # two thirds of a class are counted, each with its own word
        mine = np.array([toxic[i] == label for i in learn])
        assert (((alone - models.unknown) * (1 if label else -1))[mine] > 0.01).sum() == n
    want = dict(zip([t for _, t in rows], models.score(*text_bytes(pa.array([t for _, t in rows]))), strict=True))
    got = toxicity.toxicity(docs, spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int"))
    got = got.join(spark.createDataFrame([r for r in rows if r[0]], "doc_id bigint, text string").distinct(), "doc_id").collect()
    assert len(got) >= len(rows) - 2 and all(abs(r.score - want[r.text]) < 1e-9 for r in got if r.doc_id != 3)
    assert models.weights.any() and want["vile " * 500] > 0.7


def made_rows(spark, run):
    """What ``run`` returns, and how many rows the Python and Generate nodes of its plans made."""
    store = spark._jsparkSession.sharedState().statusStore()
    done, n = store.executionsCount(), 0
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    for i in range(done, store.executionsCount()):
        e = store.executionsList().apply(i)
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name().startswith(("MapInArrow", "Generate")):
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                n += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return out, n


def test_toxicity_reads_each_pair_as_often_in_many_rounds(spark, monkeypatch):
    """A round's pairs are read in that round alone; scores don't depend on the number of rounds."""
    rng = random.Random(5)
    learn = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = lambda i: " ".join([*(f"w{rng.randrange(60)}" for _ in range(80)), *["vile", "scum"] * (i % 4 == 1)])
    rows = [(i, text(i)) for i in range(900)] + [(None, None), (1000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in learn], "doc_id bigint, toxic int")
    models = toxicity.fit(docs, labels)
    assert models.weights.any()
    rows = docs.select("doc_id", "text")
    made, x = {}, {}
    for rounds, size in ((1, 1 << 40), (3, None), (4, 1)):
        if size is None:  # three rounds of four parts, one of which has two
            monkeypatch.setattr(toxicity, "ROUNDS", 3)
            size = 1
        else:
            monkeypatch.setattr(toxicity, "ROUNDS", 4)
        monkeypatch.setattr(toxicity, "ROUND_PAIRS", size)
        got, made[rounds] = made_rows(spark, lambda: models.measured(rows, toxicity.MARGINS)[0].collect())
        x[rounds] = sorted(((-1 if r.doc_id is None else r.doc_id), *r.x) for r in got)
    assert len(x[1]) == len(rows.collect()) and any(sum(v[1:]) > 1 for v in x[1])
    assert np.allclose(x[1], x[3], atol=1e-12) and np.allclose(x[1], x[4], atol=1e-12)
    assert made[1] > 100_000 and made[4] < 1.5 * made[1]


def test_margin_and_length():
    each, first = np.array([3.0, -1, 0.5, 2, 2]), np.array([0, 3, 3, 5])
    assert np.allclose(toxicity.Models.beyond(each, first, 1.0), [2 / np.sqrt(3), 0, 2 / np.sqrt(2)])
    assert toxicity.discounts(np.repeat([1, 2, 3, 4], [8, 4, 2, 1])).tolist() == [1 - 2 * 0.5 * 4 / 8, 2 - 3 * 0.5 * 2 / 4, 3 - 4 * 0.5 * 1 / 2]
    assert toxicity.discounts(np.ones(5)).tolist() == [0.75, 1.5, 2.25]


# conversations

MESSAGES = [
    (1, 0, "a", "Hello there\n\nHow are you?\nFine?"),
    (1, 1, "b", "On Monday a wrote:\n> Hello  THERE\n> \n> how are you?\n> Fine?\nGood."),
    (1, 2, "c", ">> How are you?\n> Good.\nMe too"),
    (1, 3, "a", "unrelated"),
    (1, 4, "b", "> never said\nodd"),
    (1, 5, "c", "> hello there how are you? fine?\n>> not this\nlate"),
    (1, 3000, "c", "> Me too\nfar"),
    (2, 0, "a", "Hello there"), (2, 1, "b", "> odd\nother conversation"), (2, 1, "b", "> odd\nother conversation"),
    (3, None, "a", "no turn"), (3, 7, None, None), (None, 0, "a", "> Hello there\nalone"), (4, 5, "x", "> self\nself"),
]


def test_quotation_linking(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in link_quotations(df.withColumn("uid", F.lit(1)).repartition(3)).collect()}
    assert len(got) == len(set(MESSAGES))
    reply = {k: r.reply_to for k, r in got.items()}
    assert reply[1, 0] is None and reply[1, 1] == 0 and reply[1, 2] == 1 and reply[1, 3] == 2 and reply[1, 4] == 3 and reply[1, 5] == 0 and reply[1, 3000] == 2
    assert reply[2, 1] == 0 and got[2, 1].copies == 2 and got[2, 1].n_linked == 0
    assert reply[3, None] is None and reply[None, 0] is None and got[None, 0].text == "alone" and got[4, 5].n_linked == 0
    assert got[1, 1].text == "Good." and got[1, 2].text == "Me too" and (got[1, 2].n_passages, got[1, 2].n_linked, got[1, 2].max_depth) == (2, 2, 2)
    assert [got[1, t].position for t in (0, 1, 2, 3, 4, 5, 3000)] == list(range(7)) and (got[3, None].position, got[3, 7].position) == (0, 1)
    assert link_quotations(df.limit(0)).count() == 0


def brute_links(messages):
    """Conversations by plain loops: each different message once, by turn."""
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    one = Counter((c, t, r, x or "") for c, t, r, x in messages)
    read = {}
    for m in one:
        own, quoted, gap = [], [], True
        lines = m[3].split("\n")
        marks = [re.match(r"(?:[ \t]*>)*", x).group() for x in lines]
        for k, (mark, line) in enumerate(zip(marks, lines, strict=True)):
            depth = mark.count(">")
            if not depth:
                if not (k + 1 < len(lines) and marks[k + 1] and re.fullmatch(r"\s*On\b.*\bwrote:\s*", line)):
                    own.append((k, line))
                gap = True
            elif not line[len(mark):].strip():
                gap = True
            else:
                if gap or quoted[-1][0] != depth:
                    quoted.append((depth, []))
                quoted[-1][1].append(norm(line[len(mark):]))
                gap = False
        blocks, last = [], None
        for k, line in own:
            if last is None or any(marks[i] for i in range(last, k)):
                blocks.append([])
            blocks[-1].append(line)
            last = k
        said = {norm("\n".join(x for _, x in own))}
        for b in blocks:
            said |= {norm("\n".join(b))} | {norm(x) for x in b} | {norm(x) for x in re.split(r"\n[ \t]*\n", "\n".join(b))}
        read[m] = "\n".join(x for _, x in own).strip("\n"), quoted, said - {""}
    out = Counter()
    for m, copies in one.items():
        conv, turn, role, _ = m
        own, quoted, _ = read[m]
        reply, linked, top = None, 0, max((d for d, _ in quoted), default=0) if conv is not None and turn is not None else 0
        if conv is not None and turn is not None:
            say = lambda x: min((n[1] for n in one if n[0] == conv and n[1] is not None and x in read[n][2]), default=turn)
            at = {}
            for depth, lines in quoted:
                whole = say(" ".join(lines))
                each = [say(x) for x in lines]
                found = whole if whole < turn else max((x for x in each if x < turn), default=None)
                if found is not None:
                    linked += 1
                    at.setdefault(depth, []).append(found)
            earlier = [n[1] for n in one if n[0] == conv and n[1] is not None and n[1] < turn]
            reply = max(at[min(at)]) if at else max(earlier, default=None)
        out[(conv, turn, role, own, reply, len(quoted) if conv is not None and turn is not None else 0, linked, top, copies)] += 1
    return out


def generated_messages(seed):
    rng, out = random.Random(seed), []
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta"]
    for conv in range(6):
        texts = []
        for turn in range(rng.randint(1, 14)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if texts and rng.random() < 0.8:
                    source = rng.choice(texts).split("\n")
                    a = rng.randrange(len(source))
                    part = source[a : a + rng.randint(1, 4)] if rng.random() < 0.7 else source
                    if rng.random() < 0.3:
                        lines.append("On Tuesday x wrote:")
                    mark = rng.choice([">", "> ", " > ", ">>"])
                    lines += [mark + (x.upper() if rng.random() < 0.2 else x.replace(" ", "  ")) for x in part]
                lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))] + [""] * rng.randint(0, 1)
            texts.append("\n".join(lines))
            out.append((conv, turn * rng.choice([1, 1, 700]), rng.choice("ab"), texts[-1]))
    return out + [out[3], out[3], (None, 1, "a", "> alpha"), (1, None, "b", "> alpha\nbeta"), (1, None, "b", None), (2, 5, None, None), (2, 2, "a", "x " * 20000 + "\n> Beta")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_quotation_linking_by_brute_force(spark, seed):
    messages = generated_messages(seed)
    df = spark.createDataFrame([(*m, "x", 1, "y", 2) for m in messages], "conv_id bigint, turn bigint, role string, text string, uid string, t int, hash string, block int").repartition(4)
    rows = link_quotations(df).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.text, r.reply_to, r.n_passages, r.n_linked, r.max_depth, r.copies) for r in rows) == brute_links(messages)
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r.conv_id].append((r.position, -1 if r.turn is None else r.turn))
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) and [t for _, t in sorted(v)] == sorted(t for _, t in v) for c, v in by_conv.items() if c is not None)


def test_a_crowded_turn_is_numbered_in_parts(spark, monkeypatch):
    from textmill.llm import quotation

    monkeypatch.setattr(quotation, "BLOCK", 16)
    messages = [(1, None, "a", f"m{k}") for k in range(300)] + [(1, t, "a", f"t{t} {k}") for t in (0, 3, 4, 90) for k in range(1 + 40 * (t == 4))] + [(2, t, "b", "x") for t in range(40)]
    rows = link_quotations(spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()
    one = sorted((r.position, r.turn, r.reply_to) for r in rows if r.conv_id == 1)
    assert [p for p, *_ in one] == list(range(len(one)))
    assert [t for _, t, _ in one] == [None] * 300 + [0, 3, *[4] * 41, 90] and {(t, x) for _, t, x in one} == {(None, None), (0, None), (3, 0), (4, 3), (90, 4)}
    assert sorted((r.position, r.turn, r.reply_to) for r in rows if r.conv_id == 2) == [(t, t, t - 1 if t else None) for t in range(40)]


def test_quote_levels():
    own, passages, says = parse("a\n> b\n> > c\n>>> d\n>\n> e\nf")
    assert own == "a\nf" and passages == [(1, ["b"]), (2, ["c"]), (3, ["d"]), (1, ["e"])] and {"a f", "a", "f"} <= set(says)


# the pipeline


def test_pipeline_stages(spark):
    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        kept[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.schema == before.schema or {f.name: f.dataType for f in docs.schema} == {f.name: f.dataType for f in before.schema}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before, after = kept["quality_classifier"]
    assert after.join(labels.where("quality = 0"), "doc_id").count() <= 0.1 * before.join(labels.where("quality = 0"), "doc_id").count()
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * before.join(labels.where("quality = 1"), "doc_id").count()
    before, after = kept["line_dedup"]
    assert after.count() == before.count() and after.where("n_chars <> length(text)").count() == 0
    before, after = kept["near_dedup"]
    from textmill.llm.simhash import simhash_groups

    groups = simhash_groups(before)
    assert after.count() == groups.select("component_id").distinct().count()
    before, after = kept["decontamination"]
    from textmill.llm.decontamination import contamination

    assert after.count() == before.count()
    hit = contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet"))
    changed = before.select("doc_id", F.col("text").alias("t")).join(after, "doc_id").where("t <> text").count()
    assert changed == hit.where("contaminated").count() > 0
    before, after = kept["best_fit_packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert packing.CAPACITY >= after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]


def write_tables(spark, folder, docs, labels, benchmark):
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_run_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, _text string, lines string, fp bigint"
    good = "This is a usual sentence of some words, and here is another one.\nA second line follows the first one, as lines do."
    texts = [(1, good), (1, good), (2, good + "\nshared line of the site"), (3, "Something else entirely is said here.\nshared line of the site"), (3, "Something else entirely is said here.\nshared line of the site"), (4, None), (5, ""), (None, "No id has this text, which is kept."), (6, "x " * 60000), (7, "the leaked words of the test are these ten and two more tail")]
    rng = random.Random(0)
    texts += [(100 + k, " ".join(f"w{rng.randrange(900)}" for _ in range(40)) + "\nshared line of the site" * (k % 3 == 0)) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", len(t or ""), "r", 0.5, "t", "l", 3) for i, t in texts], schema).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "leaked words of the test are these ten and two"), (2, None), (None, "x")], "item_id bigint, text string")
    sf = write_tables(spark, tmp_path / "odd", docs, labels, benchmark)
    placed = corpus_pipeline.run(spark, sf).collect()
    # no label says bad, so none is rejected; more than a tenth of the site's rows have the shared line
    assert {r.doc_id for r in placed} == {1, 2, 3, 4, 6, 7, None, *range(100, 130)}  # 5 is a copy of 4; repeated rows stay once
    pieces = Counter((r.doc_id, r.piece) for r in placed)
    assert set(pieces.values()) == {1} and len(pieces) > 37
    # with their texts: stage by stage
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).checkpoint()
        assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left[3] == "Something else entirely is said here." and left[2].endswith("shared line of the site") and left[7] == "the  more tail" and left[4] is None
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 and [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() for v in by_sequence.values())


def test_pipeline_run_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf = write_tables(spark, tmp_path / "none", docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_one_very_long_text_takes_a_bounded_multiple(docs):
    """30 MB in one row, in a process of its own each: what it takes beyond the text is asserted as a multiple of it."""
    code = """
import resource, sys, random, numpy as np, pyarrow as pa
from textmill.llm import packing, quality, simhash
rng = random.Random(0)
words = ["w%05d" % rng.randrange(40000) for _ in range(100000)]
text = " ".join(words * 43)[: 30 << 20]
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
ids = packing.word_ids(sys.argv[2])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
run = {"simhash": simhash._fingerprint, "packing": packing._cut(sys.argv[2], 2048, False), "quality": lambda b: [quality.Field(np.zeros(3 * quality.N_OWN), 0.0).score(*quality.text_bytes(x.column(1))) for x in b]}[sys.argv[1]]
list(run(iter([batch])))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 / 30)
"""
    for name in ("simhash", "packing", "quality"):
        done = subprocess.run([sys.executable, "-c", code, name, PATH], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2])
        assert done.returncode == 0, done.stderr
        assert float(done.stdout) < 24, (name, done.stdout)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    sf = DATA / "sf0.001"
    db = duckdb.connect()
    for p in sf.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    want = db.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, str(sf)).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert got[columns].astype(str).sort_values(columns).values.tolist() == want[columns].astype(str).sort_values(columns).values.tolist()
