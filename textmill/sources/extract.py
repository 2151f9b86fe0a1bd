"""Bytes of files to text, title and body: sniffing, and extraction by kind of file."""

from __future__ import annotations

import html
import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes at a file's head that are looked at for what no text has.
HEAD = 8192
#: Opening tags that begin a new line.
LINE_TAGS = frozenset({"br", "p", "div", "li", "h1", "h2", "tr"})
MARKDOWN, HTML, DOCX = ("md", "markdown"), ("html", "htm"), ("docx",)
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TAG = regex.compile(r"<([^>]*)>")


def sniff(data: bytes) -> tuple[str, str | None]:
    """What a file is (utf8, utf16le, utf16be, binary or nonutf8), and its text if it has one."""
    head = data[:HEAD]
    if 0 in head:
        for mark, kind, codec in ((b"\xff\xfe", "utf16le", "utf-16-le"), (b"\xfe\xff", "utf16be", "utf-16-be")):
            if data.startswith(mark):
                body = data[2:]
                return kind, body[: len(body) // 2 * 2].decode(codec, "replace")
        return "binary", None
    try:
        return "utf8", data.decode()
    except UnicodeDecodeError:
        odd = any(b < 0x20 and b not in b"\t\n\r" for b in head)
        return ("binary" if odd else "nonutf8"), None


def html_text(text: str) -> tuple[str | None, str]:
    """Title (None without one) and body of a page. Scripts and styles go; an unfinished tag ends the page."""
    title, out, at = None, [], 0
    lower = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    while (m := _TAG.search(text, at)) is not None:
        out.append(text[at : m.start()])
        name = (regex.split(r"[ \t\r\n/]", m[1].strip().lower(), maxsplit=1) or [""])[0]
        at = m.end()
        if name in ("script", "style"):
            end = lower.find(f"</{name}", at - 1)
            close = text.find(">", end) if end >= 0 else -1
            if close < 0:
                return title, html.unescape("".join(out))
            at = close + 1
        elif name == "title" and (end := lower.find("</title>", at)) >= 0:
            title = html.unescape(text[at:end]).strip()
            at = end + len("</title>")
        elif name in LINE_TAGS:
            out.append("\n")
    rest = text[at:]
    out.append(rest[: rest.find("<")] if "<" in rest else rest)
    return title, html.unescape("".join(out))


def docx_text(data: bytes) -> str:
    """Text of a Word document, a line a paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in tree.iter(_WORD + "p"):
        out.append("".join(t.text or "" for t in p.iter(_WORD + "t")) + "\n")
    return "".join(out)


def _html(batches):
    """Rows whose last column is a page's text to the same with title and body in its place."""
    for x in batches:
        pairs = [html_text(t or "") for t in x.column(x.num_columns - 1).to_pylist()]
        found = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*x.columns[:-1], *found], [*x.schema.names[:-1], "title", "body"])


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case, after the last dot of the name, unless that is its first character."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def extract_html(files: DataFrame) -> DataFrame:
    """(path, text, ...) to the same with title and body instead of text; without a title, the file's name stands for it."""
    kept = [f for f in files.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])
    out = files.select(*[f.name for f in kept], "text").mapInArrow(_html, schema)
    return out.withColumn("title", F.coalesce("title", stem(F.col("path"))))


def markdown_body(text: Column) -> Column:
    """Without the front matter between ``---`` lines, if there is one."""
    return F.regexp_replace(text, r"\A---\r?\n(?s:.*?)\n---(?:\r?\n)?", "")


def markdown_title(body: Column) -> Column:
    """The heading ``# ``, if that is the first line that isn't blank."""
    return F.nullif(F.trim(F.regexp_extract(body, r"\A\s*# ([^\n]*)", 1)), F.lit(""))


def extract(files: DataFrame) -> DataFrame:
    """(path, ext, text, ...) to the same with title and body instead of text, by ``ext``; all but HTML in DataFrame functions."""
    kept = [c for c in files.columns if c != "text"]
    pages = F.col("ext").isin(*HTML)
    plain = files.where(~pages)
    body = F.when(F.col("ext").isin(*MARKDOWN), markdown_body(F.col("text"))).otherwise(F.col("text"))
    title = F.when(F.col("ext").isin(*MARKDOWN), markdown_title(body))
    plain = plain.select(*kept, F.coalesce(title, stem(F.col("path"))).alias("title"), body.alias("body"))
    return plain.unionByName(extract_html(files.where(pages)))
