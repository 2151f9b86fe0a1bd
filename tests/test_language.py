"""The analyzer's two forms, and the query language."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions import batches
from textmill.functions.analyzer import analyze, lower, slots
from textmill.plans import syntax as ast
from textmill.plans.syntax import QuerySyntaxError, parse, parse_size, parse_time, render

#: Texts with their tokens: term, position, first and last byte, kind.
TABLE = {
    "Ruhe, 2 Boote": [("ruhe", 0, 0, 4, "word"), ("2", 1, 6, 7, "word"), ("boote", 2, 8, 13, "word")],
    "loadXMLFile": [("loadxmlfile", 0, 0, 11, "word"), ("load", 0, 0, 4, "sub"), ("xml", 1, 4, 7, "sub"), ("file", 2, 7, 11, "sub")],
    "PDFViewer": [("pdfviewer", 0, 0, 9, "word"), ("pdf", 0, 0, 3, "sub"), ("viewer", 1, 3, 9, "sub")],
    "max_row_id!": [("max", 0, 0, 3, "word"), ("row", 1, 4, 7, "word"), ("id", 2, 8, 10, "word")],
    "r7.0": [("r7", 0, 0, 2, "word"), ("0", 1, 3, 4, "word")],
    "k9Unit b52": [("k9unit", 0, 0, 6, "word"), ("k9", 0, 0, 2, "sub"), ("unit", 1, 2, 6, "sub"), ("b52", 2, 7, 10, "word")],
    "Été": [("été", 0, 0, 5, "word")],
    "雨": [("雨", 0, 0, 3, "cjk")],
    "春夏秋冬": [("春夏", 0, 0, 6, "cjk"), ("夏秋", 1, 3, 9, "cjk"), ("秋冬", 2, 6, 12, "cjk")],
    "Tee茶道z": [("tee", 0, 0, 3, "word"), ("茶道", 1, 3, 9, "cjk"), ("z", 2, 9, 10, "word")],
    "ＡｂＣ　７": [("abc", 0, 0, 9, "word"), ("ab", 0, 0, 6, "sub"), ("c", 1, 6, 9, "sub"), ("7", 2, 12, 15, "word")],
    "": [],
    "?! -- ;": [],
}


@pytest.mark.parametrize("text", TABLE)
def test_analyze(text):
    assert [(t.text, t.pos, t.start, t.end, t.kind) for t in analyze(text)] == TABLE[text]


def test_batches_agree_with_python():
    rng = random.Random(6)
    letters = "abcXYZ019 _-.éÉßİΣσ茶道雨タワー한Ａｂ１　ǅ\n😀𠀀〇ªⅠ"
    texts = [None, *TABLE, "İΣ", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500))]
    tokens = batches.analyze(pa.array(texts))
    terms, got = tokens.terms.to_pylist(), [[] for _ in texts]
    for code, row, pos in zip(tokens.code, tokens.row, tokens.pos, strict=True):
        got[row].append((pos, terms[code]))
    assert [sorted(x) for x in got] == [sorted((t.pos, t.text) for t in analyze(x or "")) for x in texts]
    assert all(x == sorted(x, key=lambda y: y[0]) for x in got)
    assert len(batches.analyze(pa.array([], pa.string())).code) == 0


def test_columns_agree_with_python(spark):
    rng = random.Random(5)
    letters = "abcXYZ019 _-.éÉßİΣσ茶道雨タワー한Ａｂ１　ǅ\n"
    texts = [*TABLE] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    rows = df.select("i", F.posexplode(slots(F.col("t"))).alias("pos", "h")).select("i", "pos", F.explode("h").alias("x")).select("i", "pos", "x.term", "x.kind").collect()
    got = {}
    for r in rows:
        got.setdefault(r.i, []).append((r.term, r.pos, r.kind))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted((x.text, x.pos, x.kind) for x in analyze(t)), t
    assert -1 not in got


def test_lower_is_one_for_one(spark):
    row = spark.range(1).select(lower(F.lit("İΣΑΣ ÀÉ")).alias("x")).first()
    assert row.x == "iσασ àé"


VALID = ["foo bar", "foo OR bar", "foo AND bar OR baz", "-foo", "NOT foo AND bar", "(a OR b) AND -c", '"exact phrase"', '"a b"~3', "title:foo path:src body:bar", "pre*", "foo~", "foo~1", "foo~2", "foo~/1", "ext:go", "size:>1mb", "size:<=10kb", "mtime:>2025-01-01", "mtime:2025-06", 'title:"hello world"~2', "-(a b)", "ORacle", "a AND", "snake_case v2.1.3"]


@pytest.mark.parametrize("query", VALID)
def test_valid_queries_render_back(query):
    tree = parse(query)
    assert parse(render(tree)) == tree


@pytest.mark.parametrize(("query", "column", "message"), [("(foo AND bar", 1, "closing parenthesis"), ("foo)", 4, "closing parenthesis"), ('"unclosed', 1, "closing quote"), ("AND foo", 1, "operand"), ("foo OR", 7, "ends too early"), ("a @ b", 3, "unexpected character"), ("", 1, "empty"), ("size:", 1, "value"), ("mtime:2025-13", 1, "date"), ("size:>x", 1, "size")])
def test_errors_point_at_their_column(query, column, message):
    with pytest.raises(QuerySyntaxError) as e:
        parse(query)
    lines = str(e.value).split("\n")
    assert e.value.column == column and message in e.value.message and len(lines) == 3 and lines[0].startswith(f"query:1:{column}: ")
    assert lines[2].index("^") == column + 1


def test_precedence_and_terms():
    assert parse("a OR b c") == ast.Or([ast.Term("a"), ast.And([ast.Term("b"), ast.Term("c")])])
    assert parse("NOT a b") == ast.And([ast.Not(ast.Term("a")), ast.Term("b")])
    assert parse("ANDroid") == ast.Term("ANDroid") and parse("title:x*") == ast.Term("x", "title", True) and parse("w~/2") == ast.Term("w", fuzzy=2)
    assert parse("size:>=10kb") == ast.Filter("size", ">=", "10kb") and parse(r'"a \"b"~') == ast.Phrase('a "b', None, 0)


def test_filter_values():
    assert [parse_size(x) for x in ("1mb", "10kb", "512", "2GB", "7b")] == [1 << 20, 10240, 512, 2 << 30, 7]
    assert parse_time("2025") == (1735689600, 1767225600) and parse_time("2024-12") == (1733011200, 1735689600)
    assert parse_time("2025-02-31") == (1740960000, 1741046400)  # runs on to 3 March
