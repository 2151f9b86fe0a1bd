"""Substring deduplication by recompression (operator 3).

Documents are dealt to chunks once, by their bytes; all passes read that one
shuffle. Names are agreed on in Spark rounds. In a round each chunk asks for the
keys that it has, each once; a bucket of keys finds those that two documents
have and numbers them; these numbers, the same for all chunks, are the names,
and come back. A key of one document gets none.

1. The first round names words, by their bytes.
2. Further rounds (:mod:`.recompression`) name runs and pairs of symbols. A
   window cannot recur where the whole context of some nameless symbol lies in
   it, since that symbol would recur too; such windows are given up, and what no
   remaining window needs is not asked for. There are as many rounds as new
   symbols' contexts fit a window.
3. What is left shares all its high-level symbols with another document and
   has to be verified. Each window goes to the bucket of one of its symbols, of
   any level, that fewest chunks have; as a symbol is the same wherever its
   context recurs, equal windows meet. Neighbouring windows of one symbol go
   together, as the names of their words, equal stretches of a chunk once, with
   the least doc_id.
4. A bucket finds equal windows by hash and compares all their words. Which
   windows an earlier document has goes back, a bit for each.
5. Chunks remove the words that such windows cover.

What is sent for a key is one entry a chunk, so a passage that a third of all
documents share is no hot group. Rows of a chunk and bucket are never more than
the chunk's keys, so all that is sent grows with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .recompression import Parse, one_round
from .words import IS_SPACE, U, find_words, joined, mix, text_bytes, word_hashes

WINDOW = 13
#: Bytes of text in a chunk, and for each bucket of keys; chunks and buckets at least.
CHUNK_BYTES, BUCKET_BYTES, LEAST = 8 << 20, 16 << 20, 32
#: Bytes of a key of a run or pair; equal ones in a bucket count as the same, which can only leave more windows to verify.
KEY_BYTES = 6
#: Low bits of a name that are not its number: 4 for the level, 5 for how common it is.
MARKS = 9
#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max

ASKED = "bucket int, chunk int, level int, keys binary, several binary"
NAMED = "chunk int, bucket int, level int, answer binary"
SOUGHT = "bucket int, chunk int, width int, words binary, sizes binary, docs binary"


def rounds_for(width: int) -> int:
    """Rounds after which new symbols, of some 1.3 words more a round and as much context at either side, still fit a window."""
    return max(1, width.bit_length() - 2)


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """The low bytes of the numbers, all first ones, then all second ones and so on: small numbers then compress well."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _bytes_for(numbers: np.ndarray) -> int:
    return max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))


def _unpacked(raw: list[bytes], widths: list[int]) -> np.ndarray:
    out = np.zeros((sum(len(x) // n for x, n in zip(raw, widths, strict=True)), 8), np.uint8)
    at = 0
    for x, n in zip(raw, widths, strict=True):
        part = np.frombuffer(x, np.uint8).reshape(n, -1).T
        out[at : at + len(part), :n] = part
        at += len(part)
    return out.view("<u8")[:, 0]


class Dealt:
    """Which bucket each of a chunk's entries goes to; entries keep their order in it."""

    def __init__(self, bucket: np.ndarray, n_buckets: int):
        self.order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[self.order], np.arange(n_buckets + 1))
        self.parts = [(b, self.order[i:j]) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i]

    def answers(self, told: pa.Table, level: int) -> list[bytes]:
        """What the buckets of ``level`` answered, in the order of ``parts``."""
        mine = told.filter(pc.equal(told["level"], level)).sort_by("bucket")
        if mine["bucket"].to_pylist() != [b for b, _ in self.parts]:
            raise ValueError("a bucket has not answered")
        return mine["answer"].to_pylist()


def _names(dealt: Dealt, told: pa.Table, level: int) -> np.ndarray:
    """The names that came back, in the order in which the keys were dealt."""
    answers = dealt.answers(told, level)
    return _unpacked(answers, [len(x) // len(o) for (_, o), x in zip(dealt.parts, answers, strict=True)])


class Words:
    """The documents of a chunk in the order of doc_id, then text, as words with one space after each."""

    def __init__(self, rows: pa.Table):
        rows = rows.select(["doc_id", "text"]).set_column(0, "doc_id", pc.fill_null(rows["doc_id"], LAST)).set_column(1, "text", pc.fill_null(rows["text"], ""))
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.ids = rows["doc_id"].to_numpy()
        data, at = text_bytes(rows["text"])
        starts, ends, self.first = find_words(data, at, IS_SPACE)
        self.text, self.starts, self.ends = joined(data, starts, ends)
        self.n = len(starts)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))


class Chunk(Words):
    """A chunk's documents and their parse as far as names are known; words are entries of the chunk's dictionary."""

    def __init__(self, rows: pa.Table, width: int, n_buckets: int):
        super().__init__(rows)
        self.width, self.n_buckets = width, n_buckets
        offsets = pa.py_buffer(np.append(self.starts, len(self.text)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), self.n, [None, offsets, pa.py_buffer(self.text)]).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)

    def several(self, entry: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of n entries, which occur in two documents."""
        least, most = np.full(n, len(self.ids)), np.full(n, -1)
        np.minimum.at(least, entry, doc)
        np.maximum.at(most, entry, doc)
        return least < most

    def dealt_words(self) -> Dealt:
        data, at = text_bytes(self.words.cast(pa.large_binary()))
        return Dealt((word_hashes(data, at[:-1], at[1:] - 1) % U(self.n_buckets)).astype(np.int64), self.n_buckets)

    def ask_words(self) -> tuple[Dealt, list[bytes], np.ndarray]:
        """What to ask for the words: their bytes, a space after each."""
        dealt = self.dealt_words()
        data, at = text_bytes(self.words.take(pa.array(dealt.order)))
        cut, raw = at[np.cumsum([0] + [len(o) for _, o in dealt.parts])].tolist(), data.tobytes()
        return dealt, [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], self.several(self.code, self.doc, len(self.words))

    def ask_symbols(self, p: Parse, asked: np.ndarray):
        """The keys of the new symbols, where they are dealt, and which key each of the symbols has."""
        keys, entry = np.unique(p.names[asked], return_inverse=True)
        return keys, Dealt(((keys >> U(48)) % U(self.n_buckets)).astype(np.int64), self.n_buckets), entry

    def parse(self, told: pa.Table | None, known: int, rounds: int):
        """Replay the rounds whose names are ``told``, levels up to ``known``; ends with what to ask next, if there is a next round."""
        if known < 0:
            return self.ask_words()
        dealt, names = self.dealt_words(), np.zeros(len(self.words), U)
        names[dealt.order] = _names(dealt, told, 0)
        self.names = names[self.code]
        self.alive = np.zeros(self.n, bool)
        if self.n >= self.width:
            self.alive[: self.n - self.width + 1] = self.doc[: self.n - self.width + 1] == self.doc[self.width - 1 :]
        nameless = np.flatnonzero(self.names == 0)
        self._give_up(nameless, nameless + 1)
        p = self._needed(Parse.of_words(self.names, self.doc))
        self.levels = [p]
        for level in range(1, rounds + 1):
            p = one_round(p, level)
            asked = p.fresh & self._fits(p)
            keys, dealt, entry = self.ask_symbols(p, asked)
            if level > known:
                return dealt, [_packed(keys[o], KEY_BYTES) for _, o in dealt.parts], self.several(entry, p.doc[asked], len(keys))
            names = np.zeros(len(keys), U)
            names[dealt.order] = _names(dealt, told, level)
            found = names[entry]
            p.names[p.fresh] = 0
            p.names[asked] = found
            nameless = np.flatnonzero(asked)[found == 0]
            self._give_up(p.low[nameless], p.high[nameless])
            p = self._needed(p)
            self.levels.append(p)
        return None

    def _give_up(self, low: np.ndarray, high: np.ndarray) -> None:
        """The windows that some [low, high) lies in."""
        fit = high - low <= self.width
        self.alive &= ~_covered(np.maximum(high[fit] - self.width, 0), low[fit] + 1, self.n)

    def _fits(self, p: Parse) -> np.ndarray:
        """Which symbols' contexts lie in a window that is left."""
        inside = (p.low >= self.first[p.doc]) & (p.high <= self.first[p.doc + 1]) & (p.high - p.low <= self.width)
        before = np.concatenate([[0], np.cumsum(self.alive)])
        return inside & (before[np.clip(p.low + 1, 0, self.n)] > before[np.clip(p.high - self.width, 0, self.n)])

    def _needed(self, p: Parse) -> Parse:
        """The symbols that reach into a window that is left."""
        start = np.flatnonzero(self.alive)
        before = np.concatenate([[0], np.cumsum(_covered(start, start + self.width, self.n))])
        return p.take(before[p.end] > before[p.begin])

    def sought(self):
        """The windows that are left, as stretches: bucket, first window and number of windows of each."""
        anchor = np.zeros(self.n, U)
        for p in self.levels:
            use = np.flatnonzero(self._fits(p) & (p.names != 0))
            low, high = p.low[use], p.high[use]
            rare = U(31) - (p.names[use] >> U(4) & U(31))
            order = (rare << U(59)) | (mix(p.names[use]) >> U(5)) | U(1)
            for k in range(self.width):
                at = low - k
                ok = (at >= 0) & (at >= high - self.width)
                ok[ok] = self.alive[at[ok]]
                np.maximum.at(anchor, at[ok], order[ok])
        start = np.flatnonzero(self.alive)
        anchor = anchor[start]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (self.doc[start[1:]] != self.doc[start[:-1]])
        begin = np.flatnonzero(first)
        return (mix(anchor[begin]) % U(self.n_buckets)).astype(np.int64), start[begin], np.diff(np.append(begin, len(start)))

    def stretches(self):
        """The different stretches: where they are dealt, first window and windows of each, least document; and of all stretches the windows, and which one each is like."""
        bucket, start, size = self.sought()
        words = size + self.width - 1
        spelt = _spans(start, words)
        at = np.cumsum(words) - words
        h = np.zeros(len(start), U)
        if len(start):
            place = spelt - np.repeat(start, words)
            h = np.add.reduceat(mix(self.names[spelt] * U(0x9FB21C651E98DF25) + place.astype(U)), at) + words.astype(U)
        _, one, like = np.unique(h, return_index=True, return_inverse=True)
        # a stretch is like another if all its words are
        same = words == words[one][like]
        check = np.flatnonzero(same)
        a, b = _spans(start[check], words[check]), _spans(start[one][like[check]], words[check])
        if len(a):
            same[check] = np.logical_and.reduceat(self.names[a] == self.names[b], np.cumsum(words[check]) - words[check])
        odd = np.flatnonzero(~same)
        like[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
        least = np.full(len(one), len(self.ids))
        np.minimum.at(least, like, self.doc[start])
        return Dealt(bucket[one], self.n_buckets), start[one], size[one], least, start, size, like


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the spans in turn."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Places from 0 to n - 1 that lie in some [begin, end)."""
    edge = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(end, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


_ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("several", pa.binary())])


def _ask(level: int, width: int, rounds: int, n_buckets: int):
    """What a chunk asks at ``level``, given the names of the levels before."""

    def asked(chunk: int, rows: pa.Table, told: pa.Table | None) -> pa.Table:
        dealt, keys, several = Chunk(rows, width, n_buckets).parse(told, level - 1, rounds)
        n = len(keys)
        return pa.table([[b for b, _ in dealt.parts], [chunk] * n, [level] * n, keys, [np.packbits(several[o]).tobytes() for _, o in dealt.parts]], schema=_ASK)

    def first(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return asked(key[0].as_py(), rows, None)

    def later(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        return asked(key[0].as_py(), rows, told) if rows.num_rows else _ASK.empty_table()

    return later if level else first


def _tell_names(n_buckets: int):
    """Name the keys of a bucket that two documents have; numbers follow the keys' order, whatever order the chunks come in."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket, level = key[0].as_py(), key[1].as_py()
        raw = rows["keys"].to_pylist()
        if level:
            each = [len(x) // KEY_BYTES for x in raw]
            found, which = np.unique(_unpacked(raw, [KEY_BYTES] * len(raw)), return_inverse=True)
            order = np.arange(len(found))
        else:
            data = np.frombuffer(b"".join(raw), np.uint8)
            stop = np.flatnonzero(data == 0x20) + 1
            cut = np.cumsum([len(x) for x in raw])
            each = np.diff(np.searchsorted(stop, cut, "right"), prepend=0).tolist()
            offsets = pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64))
            words = pa.Array.from_buffers(pa.large_binary(), len(stop), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
            found, which = words.dictionary, words.indices.to_numpy()
            order = np.empty(len(found), np.int64)
            order[pc.sort_indices(found).to_numpy()] = np.arange(len(found))
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(rows["several"].to_pylist(), each, strict=True)])
        times = np.bincount(which, weights=1 + several, minlength=len(found)).astype(np.int64)  # a chunk asks a key once
        # small numbers for common keys; and the low bits tell how common a name is
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((order, -times))] = np.arange(len(found))
        common = np.minimum(np.frexp(times)[1], 31)
        if len(found) * n_buckets >> 63 - MARKS:
            raise OverflowError("more names than 64 bits tell apart")
        names = np.where(times > 1, (rank * n_buckets + bucket << MARKS) | (common << 4) | level + 1, 0).astype(U)
        width, cut = _bytes_for(names), np.concatenate([[0], np.cumsum(each)])
        answer = [_packed(names[which[i:j]], width) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([rows["chunk"].combine_chunks(), rows["bucket"].combine_chunks(), rows["level"].combine_chunks(), pa.array(answer, pa.binary())], ["chunk", "bucket", "level", "answer"])

    return run


_SEEK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("width", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary())])


def _seek(width: int, rounds: int, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _SEEK.empty_table()
        chunk = Chunk(rows, width, n_buckets)
        chunk.parse(told, rounds, rounds)
        dealt, start, size, least, every, long, like = chunk.stretches()
        numbers = chunk.names >> U(MARKS)  # words' numbers tell them apart
        n_bytes = _bytes_for(numbers)
        words = [_packed(numbers[_spans(start[o], size[o] + width - 1)], n_bytes) for _, o in dealt.parts]
        sizes, docs = [size[o].astype("<i4").tobytes() for _, o in dealt.parts], [chunk.ids[least[o]].astype("<i8").tobytes() for _, o in dealt.parts]
        # and to itself, past the buckets: all stretches with the least document of each, and where in the answers it is
        at = np.zeros(len(size), np.int64)
        at[dealt.order] = np.cumsum(size[dealt.order]) - size[dealt.order]
        mine = np.stack([np.diff(every, prepend=0), long, chunk.doc[every] - least[like], at[like]])
        own_bytes = _bytes_for(mine)
        to = [b for b, _ in dealt.parts] + [n_buckets + key[0].as_py()]
        return pa.table([to, [key[0].as_py()] * len(to), [n_bytes] * len(words) + [own_bytes], [*words, _packed(mine.ravel(), own_bytes)], [*sizes, b""], [*docs, b""]], schema=_SEEK)

    return run


def window_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    h = np.full(len(at), 1, U)
    for k in range(width):
        h = (h ^ words[at + k]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
    return mix(h)


def alike(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window, the same for those whose words are the same: found by hash, then compared word by word."""
    _, one, group = np.unique(window_hashes(words, at, width), return_index=True, return_inverse=True)
    same = np.ones(len(at), bool)
    for k in range(width):
        same &= words[at + k] == words[at[one][group] + k]
    if not same.all():  # hashes clash: these windows among themselves, in full
        odd = np.flatnonzero(~same)
        _, again = np.unique(words[at[odd][:, None] + np.arange(width)], axis=0, return_inverse=True)
        group[odd] = len(one) + again.ravel()
    return group


def _tell_windows(width: int, level: int, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= n_buckets:  # what a chunk keeps for itself
            return pa.table([rows["chunk"].combine_chunks(), pa.array([rows["width"][0].as_py()], pa.int32()), pa.array([level + 1], pa.int32()), rows["words"].combine_chunks()], ["chunk", "bucket", "level", "answer"])
        words = _unpacked(rows["words"].to_pylist(), rows["width"].to_pylist())
        sizes = [np.frombuffer(x, "<i4").astype(np.int64) for x in rows["sizes"].to_pylist()]
        size, doc = np.concatenate(sizes), np.frombuffer(b"".join(rows["docs"].to_pylist()), "<i8")
        long = size + width - 1
        at, doc = _spans(np.cumsum(long) - long, size), np.repeat(doc, size)
        group = alike(words, at, width)
        least = np.full(int(group.max(initial=-1)) + 1, LAST)
        np.minimum.at(least, group, doc)
        earlier, cut = least[group] < doc, np.concatenate([[0], np.cumsum([x.sum() for x in sizes])])
        answer = [int(j - i).to_bytes(8, "little") + np.packbits(earlier[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([rows["chunk"].combine_chunks(), rows["bucket"].combine_chunks(), pa.array([level] * len(answer), pa.int32()), pa.array(answer, pa.binary())], ["chunk", "bucket", "level", "answer"])

    return run


def _remove(width: int, level: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        chunk = Words(rows)
        mine = told.filter(pc.equal(told["level"], level + 1))
        start, size, before, at = _unpacked(mine["answer"].to_pylist(), mine["bucket"].to_pylist()).astype(np.int64).reshape(4, -1)
        start = np.cumsum(start)
        least = chunk.doc[start] - before
        # a bucket's answer is padded to whole bytes; its number of windows is told with it
        answers = told.filter(pc.equal(told["level"], level)).sort_by("bucket")["answer"].to_pylist()
        bits = [np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")) for x in answers]
        earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        window, here = _spans(start, size), chunk.ids[np.repeat(chunk.doc[start], size)]
        gone = window[earlier[_spans(at, size)] | (here > chunk.ids[np.repeat(least, size)])]
        kept = np.flatnonzero(~_covered(gone, gone + width, chunk.n))
        words = np.diff(chunk.first)
        text, begin, _ = joined(chunk.text, chunk.starts[kept], chunk.ends[kept])
        cut = np.searchsorted(kept, chunk.first)
        begin = np.append(begin, len(text))
        raw = text.tobytes()
        out = [raw[begin[i] : begin[j] - 1] if j > i else b"" for i, j in zip(cut[:-1], cut[1:], strict=True)]
        ids = pa.array(chunk.ids, mask=chunk.ids == LAST)
        return pa.table([ids, pa.array(words), pa.array(words - np.diff(cut)), pa.array(out, pa.binary()).cast(pa.string())], schema=schema)

    return run


def without_repeats(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (the kept words, joined by one space).

    A word is removed if a window of ``width`` words of its document covers it
    whose words also begin a window in a document with a smaller doc_id. Null
    texts have no words, like empty ones. A null doc_id is greater than all
    others; rows with equal doc_ids take nothing from each other. Repeated rows
    stay, and are dealt to chunks by the partition that they are read in, so
    they make no chunk a hot one; a very long text makes its chunk as long.
    Other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_chunks, n_buckets, rounds = max(LEAST, -(-size // CHUNK_BYTES)), max(LEAST, -(-size // BUCKET_BYTES)), rounds_for(width)
    chunks = texts.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", "text").groupBy("chunk")
    told = None
    for level in range(rounds + 1):
        having = chunks if told is None else chunks.cogroup(told.groupBy("chunk"))
        asked = having.applyInArrow(_ask(level, width, rounds, n_buckets), ASKED)
        named = asked.groupBy("bucket", "level").applyInArrow(_tell_names(n_buckets), NAMED).repartition("chunk")  # so each round's names are sent once, whatever reads them
        told = named if told is None else told.unionByName(named)
    sought = chunks.cogroup(told.groupBy("chunk")).applyInArrow(_seek(width, rounds, n_buckets), SOUGHT)
    told = sought.groupBy("bucket").applyInArrow(_tell_windows(width, rounds + 1, n_buckets), NAMED)
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(_remove(width, rounds + 1), "doc_id bigint, n_words bigint, n_removed bigint, text string")


def substring_dedup(docs: DataFrame, width: int = WINDOW, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256. Rows as in :func:`without_repeats`."""
    out = without_repeats(docs, width, **columns)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
