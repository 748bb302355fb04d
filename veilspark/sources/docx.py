"""DOCX packages: their text, and sanitizing as DataFrame operations.

XML parts are edited in place: an event parser tells at which bytes the text of a node stands, and only those bytes (and
attributes that name persons) are written anew, so that everything else in a part stays as it is.

Text nodes are put together to runs, the units in which findings are looked for: an outermost table row of the body, a
header or a footer; else an outermost paragraph, comment or note; else what is left of the part. So a value that is split by
formatting is found, and the heading cell of a row is context for its neighbours.
"""

from __future__ import annotations

import io
import re
import zipfile
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate
from pathlib import PurePosixPath
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from veilspark.functions import fixed
from veilspark.functions.identity import ROW_KEY, key_of, null_safe
from veilspark.functions.spans import FINDINGS
from veilspark.operators import engine, resolve, rewrite
from veilspark.operators.recognizers import Dictionaries

UNITS = ("p", "comment", "footnote", "endnote")
EDIT = StructType([StructField("part", StringType()), StructField("run", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("new", StringType())])
TEXT_TYPE = StructType([StructField("text", StringType()), StructField("error", StringType())])
RUN = StructType([StructField("part", StringType()), StructField("run", IntegerType()), StructField("text", StringType())])
RUNS_TYPE = StructType([StructField("runs", ArrayType(RUN)), StructField("error", StringType())])
CONTENT_TYPE = StructType([StructField("content", BinaryType()), StructField("error", StringType())])
_TAG = re.compile(rb"""<(?:[^<>"']|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(rb"""(\s(?:[\w.-]+:)?([\w.-]+)\s*=\s*)("[^"]*"|'[^']*')""")


@dataclass
class Node:
    """A stretch of character data: its bytes in the part, and what they say."""

    at: int
    to: int
    text: str


@dataclass
class Part:
    """What the event parser saw of one XML part."""

    runs: list[list[Node]] = field(default_factory=list)
    data: list[Node] = field(default_factory=list)  # all character data
    tags: list[int] = field(default_factory=list)  # places of start tags with attributes
    lines: list[str] = field(default_factory=list)  # readable paragraphs


def kind_of(name: str) -> str | None:
    """What a package member is: body, note, metadata, links, or nothing to look at."""
    path = PurePosixPath(name)
    if path.suffix == ".rels":
        return "links"
    if path.suffix != ".xml":
        return None
    if path.parts[0] == "docProps":
        return "metadata"
    if path.parts[0] == "customXml" or name.startswith("word/glossary/"):
        return "note"
    if path.parts[0] != "word":
        return None
    if path.name == "document.xml" or path.name.startswith(("header", "footer")):
        return "body"
    return "note" if path.name.startswith("comments") or path.name in ("footnotes.xml", "endnotes.xml") else None


def parse(xml: bytes, rows: bool = True) -> Part:
    """Runs of text nodes, character data and tags of a part; ``rows``: table rows are runs."""
    part, rest = Part(), []
    opened: list[tuple[str, list | None, bool]] = [("", None, False)]  # name, run, inside a row
    paragraphs: list[list[str]] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = False
    pending: Node | None = None
    section: int | None = None  # where a CDATA section began

    def settle() -> None:
        # the data before this event is complete: its last byte is known now
        nonlocal pending
        if pending is not None:
            pending.to = parser.CurrentByteIndex
            pending = None

    def start(tag: str, attributes: dict) -> None:
        settle()
        name = tag.rpartition(" ")[2]
        _, run, in_row = opened[-1]
        if rows and name == "tr" and not in_row:
            run, in_row = [], True
            part.runs.append(run)
        elif run is None and name in UNITS:
            run = []
            part.runs.append(run)
        if attributes:
            part.tags.append(parser.CurrentByteIndex)
        opened.append((name, run, in_row))
        if name == "p":
            paragraphs.append([])
            part.lines.append(paragraphs[-1])
        for p in paragraphs:
            if name in ("tab", "br", "cr"):
                p.append("\t" if name == "tab" else "\n")

    def data(text: str) -> None:
        nonlocal pending
        if pending is None:
            name, run, _ = opened[-1]
            pending = Node(parser.CurrentByteIndex if section is None else section, 0, "")
            part.data.append(pending)
            if name in fixed.DOCX_TEXT_NODES:
                (rest if run is None else run).append(pending)
        pending.text += text
        if opened[-1][0] == "t":
            for p in paragraphs:
                p.append(text)

    def end(tag: str) -> None:
        settle()
        if opened.pop()[0] == "p":
            paragraphs.pop()

    def open_section() -> None:
        nonlocal section
        settle()
        section = parser.CurrentByteIndex

    def close_section() -> None:
        nonlocal section, pending
        if pending is not None:
            pending.to = parser.CurrentByteIndex + len("]]>")
        section = pending = None

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = open_section, close_section
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: settle()
    parser.Parse(xml, True)
    part.lines = ["".join(x) for x in part.lines]
    part.runs = [r for r in [*part.runs, rest] if any(n.text for n in r)]
    return part


def _utf8(xml: bytes) -> bytes:
    """The part in UTF-8, so that places and new text agree."""
    if xml[:2] in (b"\xff\xfe", b"\xfe\xff"):
        xml = re.sub(r"""(<\?xml[^>]*encoding=)["'][^"']*["']""", r'\1"UTF-8"', xml.decode("utf-16")).encode()
    named = re.match(rb"""<\?xml[^>]*encoding=["']([^"']*)["']""", xml)
    if named and named[1].lower() not in (b"utf-8", b"us-ascii"):
        xml = re.sub(r"""(<\?xml[^>]*encoding=)["'][^"']*["']""", r'\1"UTF-8"', xml.decode(named[1].decode())).encode()
    return xml


def _members(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for item in z.infolist():
            yield item, z.read(item)


def docx_text(data: bytes) -> str:
    """Paragraphs of body, headers and footers, tables included, joined by line ends; blank ones left out."""
    found = {item.filename: content for item, content in _members(data) if kind_of(item.filename) == "body"}
    names = sorted(found, key=lambda n: (("document", "header", "footer").index(re.match("document|header|footer", PurePosixPath(n).name)[0]), n))
    return "\n".join(line for n in names for line in parse(_utf8(found[n])).lines if line.strip())


def runs_of(data: bytes) -> list[tuple[str, int, str]]:
    """(part, number of the run in it, text) of everything that findings are looked for in."""
    out = []
    for item, content in _members(data):
        if kind_of(item.filename) in ("body", "note"):
            part = parse(_utf8(content), kind_of(item.filename) == "body")
            out += [(item.filename, i, "".join(n.text for n in run)) for i, run in enumerate(part.runs)]
    return out


def node_edits(lengths: list[int], edits: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str]]]:
    """Edits of a run, cut at the borders of its nodes: for each node its own edits, in its own places.

    The new text goes to the node in which a span starts; of the others the rest of the span is only taken out. Edits that overlap an
    earlier one are cut to what that leaves.
    """
    ends = list(accumulate(lengths))
    own: list[list[tuple[int, int, str]]] = [[] for _ in lengths]
    done = 0
    for start, end, new in sorted(edits):
        start = max(start, done)
        if start >= end:
            continue
        done = end
        for k in range(bisect_right(ends, start), bisect_right(ends, end - 1) + 1):
            if lengths[k]:
                base = ends[k] - lengths[k]
                own[k].append((max(start, base) - base, min(end, ends[k]) - base, new))
                new = ""
    return own


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, end, new in reversed(edits):
        text = text[:start] + new + text[end:]
    return text


def _plain_link(tag: bytes) -> bytes:
    """A relationship to outside the package without its address, which may be that of a person; those within it stay."""
    if not re.search(rb"""\sTargetMode\s*=\s*["']External["']""", tag):
        return tag
    return _ATTRIBUTE.sub(lambda m: m[1] + b'"about:blank"' if m[2] == b"Target" else m[0], tag)


def _plain_tag(tag: bytes, metadata: bool) -> bytes:
    def value(m: re.Match) -> bytes:
        name = m[2].decode()
        if name in fixed.DOCX_PERSONAL_ATTRIBUTES:
            return m[1] + b'""'
        return m[1] + b'"Anonymized"' if metadata and name in fixed.DOCX_NAMING_ATTRIBUTES else m[0]

    return _ATTRIBUTE.sub(value, tag)


def sanitize_docx(data: bytes, edits: dict[tuple[str, int], list[tuple[int, int, str]]]) -> bytes:
    """The package with ``edits`` (start, end, new text of a run) applied, properties emptied, attributes with persons and addresses of outside links blanked."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item, content in _members(data):
            kind = kind_of(item.filename)
            if kind is not None:
                content = _utf8(content)
                part = parse(content, kind == "body")
                patches = [(n.at, n.to, b"") for n in part.data if n.text.strip()] if kind == "metadata" else []
                for i, run in enumerate(part.runs if kind not in ("metadata", "links") else []):
                    for node, own in zip(run, node_edits([len(n.text) for n in run], edits.get((item.filename, i), []))):
                        if own:
                            patches.append((node.at, node.to, escape(edited(node.text, own)).encode()))
                for at in part.tags:
                    tag = _TAG.match(content, at)[0]
                    if (plain := _plain_link(tag) if kind == "links" else _plain_tag(tag, kind == "metadata")) != tag:
                        patches.append((at, at + len(tag), plain))
                pieces, done = [], 0
                for at, to, new in sorted(patches):
                    pieces += [content[done:at], new]
                    done = to
                content = b"".join([*pieces, content[done:]])
            target.writestr(item, content)
    return out.getvalue()


BROKEN = (zipfile.BadZipFile, expat.ExpatError, UnicodeError, LookupError)


def _guarded(content: pd.Series, work, *more: pd.Series) -> list[tuple]:
    """(result, error) of each package."""
    rows = []
    for b, *rest in zip(content, *more):
        try:
            rows.append((None if b is None else work(bytes(b), *rest), None))
        except BROKEN as e:
            rows.append((None, f"unreadable DOCX: {type(e).__name__}"))
    return rows


@F.pandas_udf(TEXT_TYPE)
def read_text(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_guarded(content, docx_text), columns=["text", "error"])


@F.pandas_udf(RUNS_TYPE)
def _runs(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_guarded(content, lambda b: [dict(zip(("part", "run", "text"), r)) for r in runs_of(b)]), columns=["runs", "error"])


@F.pandas_udf(CONTENT_TYPE)
def _apply(content: pd.Series, edits: pd.Series) -> pd.DataFrame:
    def work(data: bytes, found) -> bytes:
        by_run: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
        for e in found if found is not None else []:
            by_run.setdefault((e["part"], int(e["run"])), []).append((int(e["start"]), int(e["end"]), e["new"]))
        return sanitize_docx(data, by_run)

    return pd.DataFrame(_guarded(content, work, edits), columns=["content", "error"])


def sanitize(files: DataFrame, mode: str = "standard", words: Dictionaries | None = None, excluded: DataFrame | None = None, extra: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """(path, content, error) of sanitized packages, and the mapping of placeholders (row_key, doc_id, which is the path, entity_type, value, placeholder;
    None but in reversible mode).

    ``files``: path, content. ``excluded``: path, entity_type, value that stay as they are; ``extra``: path, entity_type, value that go
    besides what is found; those of a path, null included, hold for every package that has it. A package that cannot be read has an error and no content.
    Packages meet their edits by a key of path and content, so null or repeated paths do not matter; the only thing that travels is edits and packages.
    """
    keyed = files.select("path", "content", key_of(F.col("path"), F.sha2("content", 256)).alias(ROW_KEY))
    read = keyed.select("path", ROW_KEY, _runs("content").alias("r"))
    texts = read.select(F.col("path").alias("doc_id"), ROW_KEY, F.explode("r.runs").alias("u")).select("doc_id", ROW_KEY, "u.part", "u.run", "u.text")
    found = engine.detect(texts, mode, words, **options)
    if excluded is not None:
        kept = excluded.groupBy(F.col("path").alias("doc_id")).agg(F.collect_set(F.struct("entity_type", "value")).alias("_vs_kept"))
        value = lambda f: F.substring(F.col("text"), f["start"] + 1, f["end"] - f["start"])
        stays = lambda f: F.exists("_vs_kept", lambda k: (k["entity_type"] == f["entity_type"]) & (k["value"] == value(f)))
        left = F.when(F.col("_vs_kept").isNull(), F.col("findings")).otherwise(F.filter("findings", lambda f: ~stays(f)))
        found = null_safe(found, kept, ["doc_id"], "left").withColumn("findings", left.cast(FINDINGS)).drop("_vs_kept")
    if extra is not None:
        found = resolve.add_manual(found, extra.select(F.col("path").alias("doc_id"), "entity_type", "value"))
    # packages that agree in path and content have one key and the same edits
    long = engine.explode(found, ROW_KEY, "part", "run").distinct()
    mapping = None
    if mode == "reversible":
        # runs follow one another in the order of parts, so a place in the document is a run and an offset in it
        placed = long.withColumn("start", F.struct(F.col("part") != "word/document.xml", "part", "run", "start"))
        made = rewrite.numbered(texts, placed, ROW_KEY)
        edits = long.join(made, [ROW_KEY, "entity_type", "value"]).withColumnRenamed("placeholder", "new")
        mapping = edits.select(ROW_KEY, "doc_id", "entity_type", "value", F.col("new").alias("placeholder")).distinct()
    else:
        edits = long.withColumn("new", rewrite.replacement(F.col("value"), F.col("entity_type"), mode))
    grouped = edits.groupBy(ROW_KEY).agg(F.collect_list(F.struct("part", "run", "start", "end", "new")).alias("edits"))
    done = keyed.join(grouped, ROW_KEY, "left").select("path", _apply("content", "edits").alias("d"))
    return done.select("path", "d.content", "d.error"), mapping
