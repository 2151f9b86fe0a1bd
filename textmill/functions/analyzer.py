"""Text to positioned tokens: as Spark columns for the corpus, and in plain Python for queries and snippets.

A text is folded (full-width ASCII to ASCII), cut into runs of letters and
digits, and runs into tokens: CJK runs into overlapping pairs, other runs into
one word, with its parts beside it where the letter case marks an identifier.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: U+FF01-FF5E are ASCII at another width; U+3000 is a space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_FOLD = str.maketrans(_WIDE, _NARROW)

_CJK_JAVA = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_RUNS = rf"(?:[\p{{L}}&&[{_CJK_JAVA}]])+|(?:[\p{{L}}\p{{Nd}}&&[^{_CJK_JAVA}]])+"
#: Before an upper-case letter after a lower-case one or a digit; before the last of several upper-case letters.
_CUTS = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
_HAS_CUT = r"[\p{Ll}\p{Nd}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"

WORD, SUB, CJK = "word", "sub", "cjk"


def fold(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


def lower(text: Column) -> Column:
    """Lower case, one character for one; Java alone would make two of one, and another sigma at a word's end."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(_RUNS), F.lit(0))


def _slots(run: Column) -> Column:
    """One entry for each position that a run takes: the (term, kind) that stand there."""

    def token(term, kind):
        return F.struct(term.alias("term"), F.lit(kind).alias("kind"))

    n = F.length(run)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array(token(lower(run.substr(k, F.lit(2))), CJK)))
    whole = token(lower(run), WORD)
    parts = F.transform(F.split(run, _CUTS), lambda x, k: F.when(k == 0, F.array(whole, token(lower(x), SUB))).otherwise(F.array(token(lower(x), SUB))))
    return F.when(run.rlike(f"^[{_CJK_JAVA}]"), pairs).when(run.rlike(_HAS_CUT), parts).otherwise(F.array(F.array(whole)))


def slots(text: Column) -> Column:
    """array<array<struct<term, kind>>>: the tokens at positions 0, 1, 2... of a text, in one linear pass."""
    return F.flatten(F.transform(runs(text), _slots))


def terms(text: Column) -> Column:
    """All terms of a text, subwords included, in order."""
    return F.transform(F.flatten(slots(text)), lambda t: t["term"])


@dataclass(frozen=True)
class Token:
    text: str
    pos: int
    start: int  # in UTF-8 bytes
    end: int
    kind: str


_PY_RUN = regex.compile(r"(?V1)(?P<cjk>[\p{L}&&[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+)|[[\p{L}\p{Nd}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+")
_PY_CUT = regex.compile(r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")


def _lower(text: str) -> str:
    return "".join(c.lower()[0] for c in text)


def analyze(text: str) -> list[Token]:
    """Tokens with positions and byte offsets in the unfolded text."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
    out, pos = [], 0
    for m in _PY_RUN.finditer(text.translate(_FOLD)):
        s, e, run = m.start(), m.end(), m.group()
        if m.group("cjk"):
            for k in range(max(len(run) - 1, 1)):
                stop = min(s + k + 2, e)
                out.append(Token(_lower(run[k : k + 2]), pos + k, at[s + k], at[stop], CJK))
            pos += max(len(run) - 1, 1)
            continue
        out.append(Token(_lower(run), pos, at[s], at[e], WORD))
        cuts = [0, *(c.start() for c in _PY_CUT.finditer(run)), len(run)]
        if len(cuts) > 2:
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append(Token(_lower(run[a:b]), pos + k, at[s + a], at[s + b], SUB))
            pos += len(cuts) - 2
        pos += 1
    return out
