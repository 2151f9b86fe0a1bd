"""Queries of what the test tables don't show by themselves, over views and files derived from ``documents``, and the same in SQL.

``notes`` are short texts with a CJK run, an identifier, a version and, in
every fourth, full-width letters. Files are made of documents in the encodings
and formats that scanning knows; stores are written to a folder of their own.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, server
from .engine import Engine
from .functions.analyzer import analyze
from .operators.index import Index
from .operators.search import Searcher
from .operators.snippet import snippet_column
from .operators.whynot import WhyNot
from .plans.syntax import parse
from .sources.extract import extract, sniff
from .sources.ignore import Levels, parse_rules
from .sources.scan import Scan
from .sources.store import Store

_RUN = "translate(CAST(doc_id * 7919 AS {string}), '0123456789', '春夏秋冬山川雨雪茶道')"
_BODY = "concat(run, ' parse', upper(substr(lang, 1, 1)), substr(lang, 2), 'File v', CAST(doc_id % 5 AS {string}), '.', CAST(doc_id % 3 AS {string}), CASE WHEN doc_id % 4 = 0 THEN ' Ｗｉｄｅ７' ELSE '' END)"
_PATH = "concat('notes/', lang, '/n', CAST(doc_id AS {string}), '.txt')"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.expr(_RUN.format(string="STRING")).alias("run"))
    d = d.select(F.expr(_PATH.format(string="STRING")).alias("path"), F.expr(_BODY.format(string="STRING")).alias("body"), F.col("lang").alias("ext"), (F.col("doc_id") % 730).alias("mtime"))
    return d.select("path", F.lit("Notiz").alias("title"), "body", "ext", F.octet_length("body").cast("bigint").alias("size"), "mtime")


_NOTES = f"""WITH runs AS (SELECT doc_id, lang, {_RUN.format(string="VARCHAR")} AS run FROM documents),
notes AS (SELECT doc_id, lang, run, {_PATH.format(string="VARCHAR")} AS path, {_BODY.format(string="VARCHAR")} AS body, length(run) AS n, greatest(length(run) - 1, 1) AS b FROM runs)"""
#: Every token of a note: term, position, bytes, kind.
_TOKENS = f"""{_NOTES}, tokens AS (
  SELECT path, substr(run, k + 1, 2) AS term, k AS pos, 3 * k AS begin, 3 * least(k + 2, n) AS stop, 'cjk' AS kind FROM (SELECT *, unnest(range(0, b)) AS k FROM notes)
  UNION ALL SELECT path, 'parse' || lower(lang) || 'file', b, 3 * n + 1, 3 * n + 10 + length(lang), 'word' FROM notes
  UNION ALL SELECT path, 'parse', b, 3 * n + 1, 3 * n + 6, 'sub' FROM notes
  UNION ALL SELECT path, lower(lang), b + 1, 3 * n + 6, 3 * n + 6 + length(lang), 'sub' FROM notes
  UNION ALL SELECT path, 'file', b + 2, 3 * n + 6 + length(lang), 3 * n + 10 + length(lang), 'sub' FROM notes
  UNION ALL SELECT path, 'v' || CAST(doc_id % 5 AS VARCHAR), b + 3, 3 * n + 11 + length(lang), 3 * n + 13 + length(lang), 'word' FROM notes
  UNION ALL SELECT path, CAST(doc_id % 3 AS VARCHAR), b + 4, 3 * n + 14 + length(lang), 3 * n + 15 + length(lang), 'word' FROM notes
  UNION ALL SELECT path, 'wide7', b + 5, 3 * n + 16 + length(lang), 3 * n + 31 + length(lang), 'word' FROM notes WHERE doc_id % 4 = 0)"""

#: Queries over notes, and which notes match.
MATCHES = {
    "cjk_character": ("雨", "n > 1 AND contains(run, '雨')"),
    "cjk_pair": ("雨雪", "contains(run, '雨雪')"),
    "cjk_run": ("雪道夏", "contains(run, '雪道夏')"),
    "cjk_prefix": ("道夏* OR 山", "contains(run, '道夏') OR n > 1 AND contains(run, '山')"),
    "subword_phrase": ('"en file"', "lang = 'en'"),
    "subword_groups": ('"parseDeFile v2"', "lang = 'de' AND doc_id % 5 = 2"),
    "identifier": ("parseDeFile", "lang = 'de'"),
    "subword": ("parse -fr", "lang <> 'fr'"),
    "version": ("v2.1", "doc_id % 5 = 2 AND doc_id % 3 = 1"),
    "full_width": ("wide7 ＶＩ OR WIDE7", "doc_id % 4 = 0"),
    "no_tokens": ('file "?!"', "false"),
    "rare_first": ("wide7 v2 file parse", "doc_id % 4 = 0 AND doc_id % 5 = 2"),
}


def _matches(query: str):
    return lambda spark, sf_dir: Searcher(Index.of(notes(spark, sf_dir)), whole=True).query(query).matches().select("path")


def note_postings(spark, sf_dir):
    found = Index.of(notes(spark, sf_dir)).postings.where("field = 2")
    return found.select("path", "term", F.col("tf").cast("bigint").alias("tf"), F.element_at("positions", 1).cast("bigint").alias("first_pos"), F.element_at("positions", -1).cast("bigint").alias("last_pos"), F.col("len").cast("bigint").alias("len"))


def _arrow(schema: str, each):
    """A function of Arrow batches that makes rows of ``schema`` of each row."""

    def run(batches):
        for x in batches:
            rows = [r for values in zip(*(c.to_pylist() for c in x.columns), strict=True) for r in each(*values)]
            names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
            types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, t in enumerate(kinds)], list(names))

    return run


def note_tokens(spark, sf_dir):
    schema = "path string, term string, pos bigint, begin bigint, stop bigint, kind string"
    return notes(spark, sf_dir).select("path", "body").mapInArrow(_arrow(schema, lambda p, b: [(p, t.text, t.pos, t.start, t.end, t.kind) for t in analyze(b)]), schema)


def _snippets(query: str, utf16: bool):
    def run(spark, sf_dir):
        s = notes(spark, sf_dir).select("path", snippet_column(F.col("body"), parse(query), 12, utf16).alias("s"))
        return s.select("path", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.to_json("s.highlights").alias("highlights"))

    return run


def why_not(spark, sf_dir):
    """The diagnoses of four notes, and of a path that is not there."""
    diagnosis, out = WhyNot(Searcher(Index.of(notes(spark, sf_dir)).cache())), []
    paths = [r["path"] for r in notes(spark, sf_dir).where(F.col("path").rlike(r"/n[0-3]\.txt$")).select("path").collect()]
    for path in [*sorted(paths), "notes/none.txt"]:
        r = diagnosis.diagnose("parse ext:de -v1", path)
        out.append((path, r.in_index, r.match, ",".join(c.status for c in r.clauses), len(r.suggestions)))
    return spark.createDataFrame(out, "path string, in_index boolean, found boolean, statuses string, suggestions bigint")


# files


def _bytes(kind: int, doc_id: int, text: str | None) -> bytes:
    text = (text or "") + "x"
    return [lambda: text.encode(), lambda: b"\xff\xfe" + text.encode("utf-16-le"), lambda: b"P\0" + text.encode(), lambda: f"Größe {doc_id}".encode("latin-1")][kind]()


def scan_sniff(spark, sf_dir):
    """Documents in four encodings, as sniffing sees them."""
    schema = "doc_id bigint, kind string, text string"

    def each(doc_id, text):
        kind, found = sniff(_bytes(doc_id % 4, doc_id, text))
        return [(doc_id, kind, found)]

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.mapInArrow(_arrow(schema, each), schema).select("doc_id", "kind", F.sha2("text", 256).alias("text_sha256"))


def extract_files(spark, sf_dir):
    """Documents as Markdown with front matter, plain text and HTML, extracted."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.col("doc_id").cast("string").alias("i"))
    ext = F.element_at(F.array(F.lit("md"), F.lit("txt"), F.lit("html")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.when(ext == "md", F.concat(F.lit("---\nkind: x\n---\n# Titel "), "i", F.lit("\n"), "t")).when(ext == "txt", F.col("t"))
    text = text.otherwise(F.concat(F.lit("<title>T &amp; "), "i", F.lit("</title><style>p</style><p>a<b>"), "i", F.lit("</b><br>&lt;z")))
    files = d.select(F.concat(F.lit("d/f"), "i", F.lit("."), ext).alias("path"), ext.alias("ext"), text.alias("text"))
    return extract(files).select("path", "title", F.sha2("body", 256).alias("body_sha256"))


def _levels(path: str) -> Levels:
    """The rules above a path: those of the base, and in src2 its own."""
    base = Levels().below(parse_rules(".gitignore", "/src1/\n*3.txt\n"))
    return base.below(parse_rules("src2/.gitignore", "!*3.txt\n")) if path.startswith("src2/") else base


def scan_ignore(spark, sf_dir):
    """The documents' paths under the ignore rules of two folders, with the rule that decides."""
    from .queries import documents_view

    schema = "path string, ignored boolean, rule string"

    def each(path):
        rule = _levels(path).deciding(path)
        return [(path, _levels(path).ignored(path), rule.describe() if rule else None)]

    return documents_view(spark, sf_dir).select("path").mapInArrow(_arrow(schema, each), schema)


def _stated(spark, sf_dir) -> DataFrame:
    from .queries import documents_view

    d = documents_view(spark, sf_dir).withColumn("sha256", F.sha2(F.coalesce("body", F.lit("")), 256))
    return d.withColumn("k", F.regexp_extract("path", r"(\d)\.txt$", 1).cast("int"))


def scan_diff(spark, sf_dir):
    """The documents against a state that lacks, has otherwise, and has more than them; by the last digit of doc_id."""
    now = _stated(spark, sf_dir)
    path = F.when(F.col("k") == 3, F.concat(F.lit("gone/"), "path")).when(F.col("k") == 4, F.concat(F.lit("elsewhere/"), "path")).otherwise(F.col("path"))
    state = now.where("k <> 0").select(path.alias("path"), "size", (F.col("mtime") + (F.col("k") == 2).cast("int")).alias("mtime"), F.when(F.col("k") == 1, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return Scan(now, now.limit(0).select("path", F.lit("").alias("skip")), ["gone"]).diff(state)


def _folder(spark: SparkSession) -> Path:
    """A new folder for a store, where all executors see it if the cluster names such a place; removed at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://")
    folder = Path(tempfile.mkdtemp(prefix="store-", dir=shared if shared.startswith("/") else None))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _changed_store(spark, sf_dir) -> Store:
    """A store of all documents in two commits; then those ending in 1 get another body and those ending in 2 go."""
    d, store = _stated(spark, sf_dir), Store(spark, _folder(spark))
    store.commit(d.where("k < 5").drop("k"))
    store.commit(d.where("k >= 5").drop("k"))
    new = d.where("k = 1").withColumn("body", F.concat(F.lit("neu "), "ext")).withColumn("sha256", F.sha2("body", 256))
    store.commit(new.drop("k"), d.where("k = 2"))
    return store


def _store_rows(finish=None):
    def run(spark, sf_dir):
        store = _changed_store(spark, sf_dir)
        if finish:
            finish(store)
        return store.state().select("path", "mtime", "sha256")

    return run


def _merge(store: Store) -> None:
    store._merge(store.manifest.segments[:2])


def store_found(spark, sf_dir):
    """What a search finds in the changed store after compaction."""
    store = _changed_store(spark, sf_dir)
    store.compact()
    return Searcher(store.index()).query("neu ext:de").matches().select("path")


def store_stats(spark, sf_dir):
    """Documents, segments and faults of the changed store, before and after compaction."""
    store, out = _changed_store(spark, sf_dir), []
    for step in ("changed", "compacted"):
        s = store.stats()
        out.append((step, s["docs"], s["deleted"], s["segments"], s["generation"], len([w for w in store.check() if not w.startswith("left over")])))
        store.compact()
    return spark.createDataFrame(out, "step string, docs bigint, deleted bigint, segments bigint, generation bigint, faults bigint")


def _note_engine(spark, sf_dir) -> Engine:
    engine = Engine(spark, _folder(spark) / "index")
    engine.index(notes(spark, sf_dir))
    return engine


def results(spark, sf_dir):
    """What the library, the HTTP interface and the command line answer to one query: the best five and the total."""
    engine, out, printed = _note_engine(spark, sf_dir), [], []
    cli.main(["search", '"en file"', "-n", "5", "--json", "--index", str(engine.store.folder)], spark, printed.append)
    found = {"library": engine.results('"en file"', 5), "http": server.answer(engine, "/api/search?q=%22en%20file%22&n=5")[1], "command line": json.loads("\n".join(printed))}
    for way, answer in found.items():
        out += [(way, h["path"], answer["total"]) for h in answer["hits"]]
    return spark.createDataFrame(out, "way string, path string, total bigint")


def _written(folder: Path):
    """A function of Arrow batches of paths and texts that writes these as files below ``folder``."""

    def run(batches):
        for x in batches:
            for path, body in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                (folder / path).parent.mkdir(parents=True, exist_ok=True)
                (folder / path).write_text(body)
            yield pa.RecordBatch.from_arrays([pa.array([x.num_rows], pa.int64())], ["n"])

    return run


def watch_state(spark, sf_dir):
    """The state that a watch has committed of a folder of files, one a note, after half of them were changed and it was stopped."""
    folder, seen = _folder(spark), []
    rows, engine = notes(spark, sf_dir).select("path", "body"), Engine(spark, folder / ".searchindex")

    def write(some):
        """The files, written by tasks, as a scan's tasks read them; how many."""
        n = spark.sparkContext.defaultParallelism
        return some.repartition(n).mapInArrow(_written(folder), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def committed(what, n):
        """Wait, however long it takes, unless the watch has ended."""
        while sum(counts.get(what, 0) for counts in list(seen)) < n:
            if not running.query.isActive:
                raise RuntimeError(f"the watch ended: {running.query.exception()}")
            time.sleep(0.1)

    added = write(rows)
    running = engine.watch([folder], 0.2, on_commit=seen.append)
    committed("add", added)
    committed("update", write(rows.where(F.col("path").contains("/en/")).withColumn("body", F.concat("body", F.lit(" neu")))))
    running.stop()
    return engine.store.refresh().state().select("path", "size", "sha256")


QUERIES = {
    **{f"notes_{k}": _matches(q) for k, (q, _) in MATCHES.items()},
    "notes_postings": note_postings,
    "notes_tokens": note_tokens,
    "snippet_word": _snippets("file -parse", False),
    "snippet_utf16": _snippets("wide* OR zzz~", True),
    "why_not": why_not,
    "results": results,
    "watch_state": watch_state,
    "scan_sniff": scan_sniff,
    "extract_files": extract_files,
    "scan_ignore": scan_ignore,
    "scan_diff": scan_diff,
    "store_state": _store_rows(),
    "store_merged": _store_rows(_merge),
    "store_compacted": _store_rows(Store.compact),
    "store_found": store_found,
    "store_stats": store_stats,
}

_DOCS = "WITH docs AS (SELECT source || '/' || lang || '/doc' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, lang, doc_id, doc_id % 10 AS k, 1704067200 + doc_id % 730 * 86400 AS mtime, sha256(coalesce(text, '')) AS sha256 FROM documents)"
_STATE = _DOCS + " SELECT path, mtime, CASE WHEN k = 1 THEN sha256('neu ' || lang) ELSE sha256 END AS sha256 FROM docs WHERE k <> 2"

ORACLE_SQL = {
    **{f"notes_{k}": f"{_NOTES} SELECT path FROM notes WHERE {where}" for k, (_, where) in MATCHES.items()},
    "notes_postings": _TOKENS + " SELECT path, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos, any_value(len) AS len FROM tokens JOIN (SELECT path, count(*) AS len FROM tokens GROUP BY path) USING (path) GROUP BY path, term",
    "notes_tokens": _TOKENS + " SELECT path, term, CAST(pos AS BIGINT) AS pos, CAST(begin AS BIGINT) AS begin, CAST(stop AS BIGINT) AS stop, kind FROM tokens",
    "snippet_word": _NOTES + """ SELECT path, substr(body, n + length(lang) + 3, 20) AS text, CAST(3 * n + length(lang) + 2 AS BIGINT) AS start, '[{"begin":4,"end":8}]' AS highlights FROM notes""",
    "snippet_utf16": _NOTES + """ SELECT path, CASE WHEN doc_id % 4 = 0 THEN substr(body, n + length(lang) + 13, 9) ELSE substr(body, 1, 12) END AS text,
        CAST(CASE WHEN doc_id % 4 = 0 THEN 3 * n + length(lang) + 12 ELSE 0 END AS BIGINT) AS start, CASE WHEN doc_id % 4 = 0 THEN '[{"begin":4,"end":9}]' ELSE '[]' END AS highlights FROM notes""",
    "why_not": _NOTES + """ SELECT path, true AS in_index, lang = 'de' AND doc_id % 5 <> 1 AS found,
        concat_ws(',', CASE WHEN lang <> 'de' THEN 'filter_fail' END, CASE WHEN doc_id % 5 = 1 THEN 'not_triggered' END) AS statuses,
        CAST(CASE WHEN (lang <> 'de') <> (doc_id % 5 = 1) THEN 1 ELSE 0 END AS BIGINT) AS suggestions FROM notes WHERE doc_id < 4
        UNION ALL SELECT 'notes/none.txt', false, false, '', 0""",
    "results": _NOTES + """, best AS (SELECT path, count(*) OVER () AS total FROM notes WHERE lang = 'en' ORDER BY path LIMIT 5)
        SELECT way, path, total FROM best, (SELECT unnest(['library', 'http', 'command line']) AS way)""",
    "watch_state": _NOTES + """, now AS (SELECT path, body || CASE WHEN lang = 'en' THEN ' neu' ELSE '' END AS body FROM notes) SELECT path, strlen(body) AS size, sha256(body) AS sha256 FROM now""",
    "scan_sniff": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf8' WHEN 1 THEN 'utf16le' WHEN 2 THEN 'binary' ELSE 'nonutf8' END AS kind,
        CASE WHEN doc_id % 4 < 2 THEN sha256(coalesce(text, '') || 'x') END AS text_sha256 FROM documents""",
    "extract_files": """SELECT 'd/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.html' END AS path,
        CASE doc_id % 3 WHEN 0 THEN 'Titel ' || doc_id WHEN 1 THEN 'f' || doc_id ELSE 'T & ' || doc_id END AS title,
        sha256(CASE doc_id % 3 WHEN 0 THEN '# Titel ' || doc_id || chr(10) || coalesce(text, '') WHEN 1 THEN coalesce(text, '') ELSE chr(10) || 'a' || doc_id || chr(10) || '<z' END) AS body_sha256 FROM documents""",
    "scan_ignore": _DOCS + """ SELECT path, rule IS NOT NULL AND rule NOT LIKE '%(src2/%' AS ignored, rule FROM (SELECT path, CASE WHEN path LIKE 'src2/%3.txt' THEN '*3.txt (src2/.gitignore:1)' WHEN path LIKE '%3.txt' THEN '*3.txt (.gitignore:2)' WHEN path LIKE 'src1/%' THEN 'src1 (.gitignore:1)' END AS rule FROM docs)""",
    "scan_diff": _DOCS + """ SELECT path, CASE WHEN k IN (0, 3, 4) THEN 'add' WHEN k = 1 THEN 'update' WHEN k = 2 THEN 'mtime' ELSE 'unchanged' END AS change FROM docs UNION ALL SELECT 'gone/' || path, 'delete' FROM docs WHERE k = 3""",
    "store_state": _STATE,
    "store_merged": _STATE,
    "store_compacted": _STATE,
    "store_found": _DOCS + " SELECT path FROM docs WHERE k = 1 AND lang = 'de'",
    "store_stats": _DOCS + """, n AS (SELECT count(*) FILTER (k <> 2) AS docs, count(*) FILTER (k IN (1, 2)) AS deleted FROM docs)
        SELECT 'changed' AS step, docs, deleted, CAST(3 AS BIGINT) AS segments, CAST(3 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS faults FROM n UNION ALL SELECT 'compacted', docs, 0, 1, 4, 0 FROM n""",
}
