"""Chat formatting by quotation linking (operator 1).

Messages are parsed into their own text and quoted passages at nested levels.
A passage, white space and case normalised, is hashed and joined to the first
message of its conversation that says it; so every message learns what it
replies to, and conversations are built in reply order without quotes. Nothing
is gathered by conversation, so one with a third of all messages is no hot
group: passages meet by conversation and hash, and positions are counted by
blocks of turns. A block in which more than BLOCK messages share one turn, or
have none, is split by turn and hash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, prepare

#: Turns that are numbered together; and messages of one turn beyond which they are numbered apart.
BLOCK = 1024
#: Quoted hashes that are broadcast at most, to leave out what nobody quotes before it is shuffled.
BROADCAST_ASKED = 200_000
_QUOTED = re.compile(r"[ \t]*>")
_WROTE = re.compile(r"\s*On\b.*\bwrote:\s*")


def depth_of(line: str) -> tuple[int, str]:
    """How many quote marks a line begins with, and what follows them."""
    depth = at = 0
    while m := _QUOTED.match(line, at):
        depth, at = depth + 1, m.end()
    return depth, line[at:] if depth else line


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]], list[str]]:
    """A message's own text; its passages (depth, normalised lines); and what it says, normalised: all, blocks, paragraphs, lines.

    A passage is a stretch of quoted lines of one depth without a blank line.
    A line "On ... wrote:" right before a quotation is not the author's text.
    """
    lines = [depth_of(x) for x in (text or "").split("\n")]
    own, passages, blocks = [], [], [[]]
    for k, (depth, rest) in enumerate(lines):
        if depth:
            if not rest.strip():
                passages.append((depth, []))
            elif passages and passages[-1][0] == depth and k and lines[k - 1][0] == depth:
                passages[-1][1].append(normalised(rest))
            else:
                passages.append((depth, [normalised(rest)]))
            if blocks[-1]:
                blocks.append([])
        elif not (k + 1 < len(lines) and lines[k + 1][0] and _WROTE.fullmatch(rest)):
            own.append(rest)
            blocks[-1].append(rest)
    says = {normalised("\n".join(own))}
    for b in blocks:
        says.update(normalised(p) for p in ["\n".join(b), *re.split(r"\n[ \t]*\n", "\n".join(b)), *b])
    return "\n".join(own).strip("\n"), [(d, x) for d, x in passages if x], sorted(says - {""})


_PASSAGES = pa.list_(pa.struct([("passage", pa.int32()), ("depth", pa.int32()), ("part", pa.int32()), ("hash", pa.binary())]))


def _parse(batches):
    for x in batches:
        own, passages, says = [], [], []
        for text in x.column("text").to_pylist():
            mine, quoted, said = parse(text)
            own.append(mine)
            rows = []
            for k, (depth, lines) in enumerate(quoted):
                # part 0 is the whole passage, part 1 its lines one by one, for passages cut from more than one place
                rows += [{"passage": k, "depth": depth, "part": p, "hash": digest(t)} for p, t in [(0, " ".join(lines)), *((1, t) for t in lines)]]
            passages.append(rows)
            says.append([digest(t) for t in said])
        kept = [x.column(c) for c in ("uid", "conv_id", "turn", "role", "copies", "t", "block")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.string()), pa.array(passages, _PASSAGES), pa.array(says, pa.list_(pa.binary()))], ["uid", "conv_id", "turn", "role", "copies", "t", "block", "own", "passages", "says"])


_PARSED = "uid string, conv_id bigint, turn bigint, role string, copies bigint, t bigint, block bigint, own string, passages array<struct<passage: int, depth: int, part: int, hash: binary>>, says array<binary>"


def _placed(messages: DataFrame, total: int) -> DataFrame:
    """``messages`` with position, by (t, uid) in the conversation, and previous, the last turn before theirs."""
    crowded = messages.groupBy("conv_id", "block", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id", "block").agg(F.max("n").alias("most"), F.sum("n").alias("all")).where(F.col("most") > BLOCK).select("conv_id", "block", "all")
    apart = F.lit(False)
    if not crowded.isEmpty():
        messages = lookup(messages, crowded.withColumn("crowded", F.lit(True)), ["conv_id", "block"], "all", total, "uid")
        apart = F.col("crowded").isNotNull()
    # within a block: one part; or one for each turn and the first letters of the hash
    dealt = messages.withColumn("by_turn", F.when(apart, F.col("t"))).withColumn("by_hash", F.when(apart, F.substring("uid", 1, 2)))
    part, turns = ["conv_id", "block", "by_turn", "by_hash"], ["conv_id", "block", "by_turn"]
    parts = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("block", "by_turn", "by_hash").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ends = parts.groupBy(*turns).agg(F.max("last").alias("last"))
    ends = ends.select(*turns, F.max("last").over(Window.partitionBy("conv_id").orderBy("block", "by_turn").rowsBetween(Window.unboundedPreceding, -1)).alias("last_before"))
    inside = Window.partitionBy(*part).orderBy("t", "uid")
    lower = F.max("turn").over(Window.partitionBy(*part).orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    numbered = dealt.select("*", (F.row_number().over(inside) - 1).alias("k"), lower.alias("turn_before"))
    sums = _joined(sums, ends, turns)
    placed = _joined(numbered, sums, part)
    return placed.select("uid", "conv_id", "turn", "role", "own", "copies", (F.col("k") + F.col("before")).alias("position"), F.coalesce("turn_before", "last_before").alias("previous"))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` with the columns of its row in ``right``; null keys are equal."""
    named = right.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(named, same).drop(*[f"_{c}" for c in on])


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per different message, to be read by conv_id and position.

    Columns: conv_id, position (from 0, by turn, then a hash), turn, role, text
    (without quotes), reply_to (a turn), n_passages, n_linked, max_depth,
    copies. ``reply_to`` is the latest of the messages that the passages of the
    lowest linked depth come from; without any, the turn before. A message links
    only to earlier turns, so every reply comes after what it answers. Rows
    that repeat conv_id, turn, role and text are one message, ``copies`` many.
    Null text is empty; a null turn comes first and links to nothing; messages
    without conv_id stand alone at position 0. A very long text is parsed like any
    other, in the row that holds it. Other columns are not read; an empty table
    gives no rows.
    """
    prepare(messages.sparkSession)
    rows = messages.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ["conv_id", "turn", "role", "text"]
    one = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    uid = F.md5(F.concat_ws("\x1f", F.to_json(F.struct("conv_id", "turn", "role")), F.sha2("text", 256)))
    one = one.withColumn("uid", uid).withColumn("t", F.coalesce("turn", F.lit(-(1 << 62)))).withColumn("block", F.floor(F.col("t") / BLOCK))
    parsed = one.mapInArrow(_parse, _PARSED).checkpoint()

    passages = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("uid", "conv_id", "turn", F.explode("passages").alias("q")).select("uid", "conv_id", "turn", "q.*").checkpoint()
    n_asked = passages.count()
    asked = passages.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("asked"))
    said = parsed.where(F.col("turn").isNotNull()).select("conv_id", "turn", F.explode("says").alias("hash"))
    # only what is quoted somewhere is looked for; the first to say it is the original
    if n_asked <= BROADCAST_ASKED:
        said = said.join(F.broadcast(asked.select("conv_id", "hash")), ["conv_id", "hash"], "left_semi")
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("said_at")).join(asked, ["conv_id", "hash"])
    found = lookup(passages, first.select("conv_id", "hash", "said_at", "asked"), ["conv_id", "hash"], "asked", n_asked, "uid")
    found = found.withColumn("at", F.when(F.col("said_at") < F.col("turn"), F.col("said_at")))
    whole = F.max(F.when(F.col("part") == 0, F.col("at")))
    each = found.groupBy("uid", "passage", "depth").agg(F.coalesce(whole, F.max("at")).alias("at"))
    linked = F.when(F.col("at").isNotNull(), F.col("depth"))
    # the latest original of the lowest depth: least (depth, -turn)
    best = F.min(F.when(F.col("at").isNotNull(), F.struct(F.col("depth").alias("d"), (-F.col("at")).alias("minus"))))
    links = each.groupBy("uid").agg((-best["minus"]).alias("quoted"), F.count(F.lit(1)).alias("n_passages"), F.count(linked).alias("n_linked"), F.max("depth").alias("max_depth"))

    placed = _placed(parsed.drop("passages", "says").where(F.col("conv_id").isNotNull()), parsed.count())
    alone = parsed.where(F.col("conv_id").isNull()).select("uid", "conv_id", "turn", "role", "own", "copies", F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("bigint").alias("previous"))
    out = placed.unionByName(alone).join(links, "uid", "left")
    return out.select(
        "conv_id", F.col("position").cast("bigint").alias("position"), "turn", "role", F.col("own").alias("text"),
        F.when(F.col("turn").isNotNull(), F.coalesce("quoted", "previous")).alias("reply_to"),
        F.coalesce("n_passages", F.lit(0)).cast("bigint").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.coalesce("max_depth", F.lit(0)).cast("int").alias("max_depth"), "copies",
    )
