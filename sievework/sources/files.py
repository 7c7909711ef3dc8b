"""Sources: folders, text, office formats, notebooks, evaluation files, JSON-lines requests.

`binaryFile` lists and reads a folder on the executors; the parsers below are functions from bytes to text that run over
Arrow batches. PDF pages, pictures, sound and video need decoders that are not installed here: `MediaReader` is the
interface that one implements.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.operators import rules

from . import folder_source

ENTRY_CAP, TEXT_CAP = 64 << 20, 10_000_000
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class MediaReader(Protocol):
    """Pages of a PDF, pixels of a picture, windows of sound, frames of a video."""

    def segments(self, content: bytes) -> Iterator[tuple[str, float, float, str]]: ...


def crawl(spark: SparkSession, root: str, include_code: bool = False, progress: Observation | None = None, excluded: list[str] = ()) -> DataFrame:
    """path, action, kind, reason, size, mtime, inode, device of the files under root: those worth indexing, and the rest
    with the reason they are left out. progress: gets `files` and `bytes` once the crawl is read.

    A folder that executors see is walked by the source `folder`, which lists nothing that it doesn't enter; other
    stores are listed by Spark's own reader, and have no inodes."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", root):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
        rows = found.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), F.xxhash64("path").alias("inode"), F.lit(0).cast("long").alias("device"), F.lit(None).cast("string").alias("left"))
        rows = rows.where(rules.is_walked(F.col("path"), F.lit(root.rstrip("/"))))
    else:
        folder_source.register(spark)
        found = spark.read.format("folder").option("excluded", json.dumps(list(excluded))).option("code", include_code).load(re.sub("^file:/*", "/", root))
        rows = found.where(~F.col("folder") & ~rules.name_of(F.col("path")).startswith(".")).select("path", "size", "mtime", "inode", "device", F.col("reason").alias("left"))
    rows = rows.withColumn("class", rules.classify(F.col("path"), include_code=include_code))
    action = F.when(F.col("left").isNotNull(), "skip").otherwise(F.col("class.action"))
    out = rows.select("path", action.alias("action"), "class.kind", F.coalesce("left", "class.reason").alias("reason"), "size", "mtime", "inode", "device")
    return out if progress is None else out.observe(progress, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def with_inodes(files: DataFrame) -> DataFrame:
    """files with inode and device as executors see them; where a path isn't in a file system that they share, a hash of
    the path, which finds no moves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                try:
                    s = os.stat(path)
                    found.append((path, s.st_ino - (1 << 64) if s.st_ino >> 63 else s.st_ino, s.st_dev))
                except OSError:
                    found.append((path, None, None))
            yield pd.DataFrame({"path": [f[0] for f in found], "inode": pd.array([f[1] for f in found], "Int64"), "device": pd.array([f[2] for f in found], "Int64")})

    seen = files.select("path").mapInPandas(run, "path string, inode long, device long")
    return files.join(seen, "path").withColumns({"inode": F.coalesce("inode", F.xxhash64("path")), "device": F.coalesce("device", F.lit(0).cast("long"))})


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _entry(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > ENTRY_CAP:
        raise ValueError("entry too large")
    data = archive.read(info)
    if b"<!DOCTYPE" in data[:2000]:
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (type, path) of a part's relations inside the archive."""
    folder, _, name = part.rpartition("/")
    root = _entry(archive, f"{folder}/_rels/{name}.rels".lstrip("/"))
    out = {}
    for r in root if root is not None else ():
        if r.get("TargetMode") == "External":
            continue
        target = r.get("Target", "")
        parts: list[str] = [] if target.startswith("/") else [p for p in folder.split("/") if p]
        for p in target.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], "/".join(parts))
    return out


def _all_text(e: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == tag)


def xlsx_text(content: bytes) -> str:
    """Sheets in the workbook's order: name, then rows with tabs between cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, related = _entry(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        strings = _entry(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for run in s if _tag(run) in ("t", "r") for t in ([run] if _tag(run) == "t" else [x for x in run if _tag(x) == "t"])) for s in strings] if strings is not None else []
        lines = []
        for sheet in (e for e in book.iter() if _tag(e) == "sheet"):
            lines.append(sheet.get("name", ""))
            page = _entry(z, related.get(_attribute(sheet, "id") or "", ("", ""))[1])
            for row in (e for e in page.iter() if _tag(e) == "row") if page is not None else ():
                cells = []
                for c in (e for e in row if _tag(e) == "c"):
                    kind, value = c.get("t", "n"), next((e.text for e in c if _tag(e) == "v"), None)
                    if kind == "inlineStr":
                        cells.append(_all_text(c, "t"))
                    elif value is not None and kind not in ("b", "e"):
                        cells.append(shared[int(value)] if kind == "s" else value)
                if any(cells):
                    lines.append("\t".join(cells))
        return "\n".join(lines)[:TEXT_CAP]


def _paragraphs(e: ElementTree.Element) -> list[str]:
    """Text of paragraphs; fields, which hold page numbers and dates, are left out."""
    out = []
    for p in (x for x in e.iter() if _tag(x) == "p"):
        text = "".join("".join(t.text or "" for t in r if _tag(t) == "t") if _tag(r) == "r" else "\n" if _tag(r) == "br" else "" for r in p)
        if text.strip():
            out.append(text)
    return out


def pptx_text(content: bytes) -> str:
    """Slides in the deck's order, each with its notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        deck, related = _entry(z, "ppt/presentation.xml"), _relations(z, "ppt/presentation.xml")
        lines = []
        for ref in (e for e in deck.iter() if _tag(e) == "sldId"):
            path = related.get(next((v for k, v in ref.attrib.items() if k.endswith("}id")), ""), ("", ""))[1]
            slide = _entry(z, path) if path else None
            if slide is None:
                continue
            lines += _paragraphs(slide)
            for kind, target in _relations(z, path).values():
                if kind == "notesSlide" and (notes := _entry(z, target)) is not None:
                    lines += _paragraphs(notes)
        return "\n".join(lines)[:TEXT_CAP]


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _entry(z, "word/document.xml")
        return "\n".join("".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "" for x in p.iter()) for p in body.iter() if _tag(p) == "p").strip()[:TEXT_CAP]


_UNSEEN = {"annotation", "page-number", "date", "time", "creator", "tracked-changes"}


def _flow(e: ElementTree.Element) -> str:
    out = [e.text or ""]
    for child in e:
        name = _tag(child)
        if name in _UNSEEN:
            pass
        elif name == "s":
            out.append(" " * int(_attribute(child, "c") or 1))
        elif name in ("tab", "line-break"):
            out.append("\t" if name == "tab" else "\n")
        else:
            out.append(_flow(child))
        out.append(child.tail or "")
    return "".join(out)


def open_document_text(content: bytes) -> str:
    """ODT, ODS and ODP: sheets as rows with tabs, pages and text as paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _entry(z, "content.xml")
    tables = [e for e in body.iter() if _tag(e) == "spreadsheet"]
    lines: list[str] = []
    if tables:
        for sheet in (e for e in tables[0].iter() if _tag(e) == "table"):
            lines.append(_attribute(sheet, "name") or "")
            for row in (e for e in sheet.iter() if _tag(e) == "table-row"):
                cells = [" ".join(_flow(p) for p in c if _tag(p) == "p") for c in row if _tag(c) == "table-cell"]
                if any(x.strip() for x in cells):
                    lines.append("\t".join(x for x in cells if x))
    else:
        lines = [t for p in body.iter() if _tag(p) in ("p", "h") and (t := _flow(p)).strip()]
    return "\n".join(lines)[:TEXT_CAP]


_CONTROL = re.compile(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
_HIDDEN = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer", b"object"}


def rtf_text(content: bytes) -> str:
    """RTF's text: cp1252 letters, \\u code points, paragraphs and tabs; hidden groups left out."""
    out: list[str] = []
    groups: list[tuple[bool, int]] = []
    hidden, fallback, skip = False, 1, 0
    for word, number, code, symbol, brace, plain in _CONTROL.findall(content):
        if brace == b"{":
            groups.append((hidden, fallback))
        elif brace == b"}":
            hidden, fallback = groups.pop() if groups else (False, 1)
        elif symbol == b"*" or word in _HIDDEN:
            hidden = True
        elif word == b"uc":
            fallback = int(number or 1)
        elif hidden:
            continue
        elif word == b"u":
            # 16 bits, negative ones from above; what is beyond them is no letter.
            point = int(number or 0)
            out.append(chr(point % 65536) if -32768 <= point <= 65535 else "")
            skip = fallback
        elif word in (b"par", b"line", b"row"):
            out.append("\n")
        elif word in (b"tab", b"cell"):
            out.append("\t")
        elif code or symbol in (b"\\", b"{", b"}", b"~"):
            if skip:
                skip -= 1
            else:
                out.append(bytes.fromhex(code.decode()).decode("cp1252", "replace") if code else " " if symbol == b"~" else symbol.decode())
        elif plain:
            text = plain.decode("cp1252", "replace")
            out.append(text[skip:])
            skip = max(0, skip - len(text))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def html_text(content: bytes) -> str:
    """HTML's text by the standard library's parser: for files, which come as bytes."""
    parts: list[str] = []
    hidden: list[str] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "head"):
                hidden.append(tag)
            parts.append("\n" if tag == "br" else " ")

        def handle_endtag(self, tag):
            if tag in hidden:
                del hidden[hidden.index(tag) :]
            parts.append("\n" if re.fullmatch("p|div|li|h[1-6]|tr|section|article", tag) else " ")

        def handle_data(self, data):
            if not hidden:
                parts.append(data)

    Reader().feed(decoded(content))
    lines = (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


PARSERS = {"html": html_text, "htm": html_text, "xlsx": xlsx_text, "pptx": pptx_text, "docx": docx_text, "odt": open_document_text, "ods": open_document_text, "odp": open_document_text, "rtf": rtf_text}


def read_text(ext: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error). A password-protected office file is an OLE container, and locked; so is an old word file, of
    which no parser is here, unreadable."""
    if content.startswith(OLE) and ext != "rtf":
        return None, "unreadable" if ext == "doc" else "locked"
    try:
        text = PARSERS.get(ext, decoded)(content)
    except Exception:
        return None, "unreadable"
    return (text, None) if text.strip() else (None, "empty")


def texts(files: DataFrame) -> DataFrame:
    """(path, content) to path, text, error: one bad file costs its own row only."""
    cut = files.select("path", rules.extension_of(F.col("path")).alias("ext"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, *read_text(e, bytes(c))) for p, e, c in zip(frame["path"], frame["ext"], frame["content"], strict=True)]
            yield pd.DataFrame(found, columns=["path", "text", "error"])

    return cut.mapInPandas(run, "path string, text string, error string")


def eval_file(spark: SparkSession, path: str) -> DataFrame:
    """query, tag, kind, expected path and range of an evaluation file."""
    schema = "base string, queries array<struct<q:string,expect:array<string>,tag:string,kind:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("base", F.explode("queries").alias("e")).select("base", "e.*", F.explode("e.expect").alias("target"))
    span = F.regexp_extract("target", r"@(\d+)-(\d+)$", 1), F.regexp_extract("target", r"@(\d+)-(\d+)$", 2)
    first, last = (F.when(x != "", x.cast("long")) for x in span)
    return rows.select(F.col("q").alias("query"), "tag", "kind", F.regexp_replace("target", r"@\d+-\d+$", "").alias("path"), first.alias("first"), last.alias("last"))


def requests(lines: DataFrame, schema: str = "op string, id long, query string, path string") -> DataFrame:
    """JSON-lines requests of a text source or stream; what is no JSON gives nulls."""
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
