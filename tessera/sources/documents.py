"""Documents of many formats as units: rows of (kind, anchor, text, title, parent_anchor, ordinal, locator, metadata).

Files are read by Spark's ``binaryFile`` source, which lists, filters and splits them; a parser then runs on each file's
bytes in Arrow batches on the executors. A format that can't be parsed gives one unit of kind ``error``.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import html.parser
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import spreadsheet

UNIT = "kind string, anchor string, text string, title string, parent_anchor string, ordinal int, locator map<string,string>, metadata map<string,string>"
MOST_BYTES = 64 << 20
#: Units or chunks that a task holds before it passes them on.
HELD = 2_000

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "cp1252", "latin-1")


def decoded(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


class Units(list):
    """Units in order, under the headings that they stand below."""

    def __init__(self):
        super().__init__()
        self.title, self.parent = "", ""

    def put(self, kind: str, text: str, parent: str | None = None, **locator) -> None:
        text = text.strip()
        if text:
            anchor = f"{kind}:{len(self) + 1}"
            where = {k: str(v) for k, v in locator.items()}
            self.append({"kind": kind, "anchor": anchor, "text": text, "title": self.title, "parent_anchor": self.parent if parent is None else parent, "ordinal": len(self), "locator": where, "metadata": {}})
            if kind == "heading":
                self.title, self.parent = text.lstrip("# "), anchor


def plain(raw: bytes, units: Units) -> None:
    """Headings (# or underlined by = or -) and paragraphs parted by blank lines, with their first line's number."""
    block: list[str] = []
    begin = 1

    def close():
        units.put("paragraph", "\n".join(block), line=begin)
        block.clear()

    lines = decoded(raw).splitlines()
    for n, line in enumerate(lines, 1):
        if re.match(r"#{1,6}\s+\S", line):
            close()
            units.put("heading", line.lstrip("# "), line=n)
        elif re.fullmatch(r"\s*(=+|-+)\s*", line) and len(block) == 1 and len(line.strip()) >= 3:
            head = block.pop()
            units.put("heading", head, line=n - 1)
        elif not line.strip():
            close()
        else:
            if not block:
                begin = n
            block.append(line)
    close()


class _Html(html.parser.HTMLParser):
    SKIPPED = {"script", "style", "noscript", "svg", "canvas"}
    BLOCK = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody tfoot thead title tr ul".split())

    def __init__(self, units: Units):
        super().__init__(convert_charrefs=True)
        self.units, self.text, self.skip, self.heading = units, [], 0, ""

    def flush(self) -> None:
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.text)).strip(" |\n")
        self.text = []
        self.units.put("heading" if self.heading else "paragraph", re.sub(r"\s*\n\s*", " ", text))

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in ("td", "th"):
            self.text.append(" | " if "".join(self.text).strip() else "")
        elif tag in self.BLOCK:
            self.flush()
            self.heading = tag if re.fullmatch("h[1-6]|title", tag) else ""

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCK:
            self.flush()
            self.heading = ""

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_page(raw: bytes, units: Units) -> None:
    parser = _Html(units)
    parser.feed(decoded(raw))
    parser.close()
    parser.flush()


def json_leaves(raw: bytes, units: Units) -> None:
    """``pointer = value`` for every leaf (RFC 6901); lines if it isn't JSON."""
    try:
        tree = json.loads(decoded(raw))
    except ValueError:
        return json_lines(raw, units)
    open_ = [("", tree)]
    while open_:
        pointer, x = open_.pop()
        if isinstance(x, dict) and x:
            open_ += [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list) and x:
            open_ += [(f"{pointer}/{i}", v) for i, v in reversed(list(enumerate(x)))]
        else:
            units.put("json_value", f"{pointer or '/'} = {json.dumps(x, ensure_ascii=False) if not isinstance(x, str) else x}", pointer=pointer)
    return None


def json_lines(raw: bytes, units: Units) -> None:
    for n, line in enumerate(decoded(raw).splitlines(), 1):
        units.put("record", line, line=n)


def table_rows(raw: bytes, units: Units, separator: str = ",") -> None:
    """The header as it stands, then ``header=value | ...`` for every row; values under a secret header are replaced."""
    header: list[str] = []
    for n, row in enumerate(csv.reader(io.StringIO(decoded(raw)), delimiter=separator), 1):
        if n == 1:
            header = row
            units.put("header", " | ".join(row), row=n)
        else:
            units.put("row", " | ".join(f"{header[i] if i < len(header) and header[i] else i + 1}={_safe(header[i] if i < len(header) else '', v)}" for i, v in enumerate(row) if v.strip()), row=n)


def _safe(label: str, value: str) -> str:
    from tessera.functions.patterns import SECRET_LABEL

    return "<REDACTED>" if re.fullmatch(r"(?i)\s*" + SECRET_LABEL + r"\s*[:=\-–—]?\s*", label) else value


def rtf(raw: bytes, units: Units) -> None:
    text = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", raw.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text))
    plain(re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", re.sub(r"\\(?:par|line)\b ?", "\n\n", text)).encode(), units)


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise ValueError("xml with a document type")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element, leaf: str = "t") -> str:
    return "".join((x.text or "") if _local(x) == leaf else "\t" if _local(x) == "tab" else "\n" if _local(x) == "br" else "" for x in e.iter())


def docx(raw: bytes, units: Units) -> None:
    """Body paragraphs, headings by style, tables by rows, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))]
        for name in names:
            root = _xml(z, name)
            if root is None:
                continue
            part = name.rpartition("/")[2].removesuffix(".xml")
            for e in root.find("{*}body") if part == "document" and root.find("{*}body") is not None else root:
                if _local(e) == "p":
                    style = next((x.get(k) or "" for x in e.iter() if _local(x) == "pStyle" for k in x.keys() if k.endswith("val")), "")
                    units.put("heading" if re.match(r"(?i)heading|title", style) and part == "document" else part if part != "document" else "paragraph", _text(e), part=part)
                elif _local(e) == "tbl":
                    for n, row in enumerate((r for r in e if _local(r) == "tr"), 1):
                        units.put("table_row", " | ".join(_text(c).strip() for c in row if _local(c) == "tc"), row=n)


def xlsx(raw: bytes, units: Units) -> None:
    """Rows of every sheet, cells with a formula, and the formula's references."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [_text(s) for s in _xml(z, "xl/sharedStrings.xml") or []]
        book = _xml(z, "xl/workbook.xml")
        names = [e.get("name") or f"Sheet{i}" for i, e in enumerate((e for e in book.iter() if _local(e) == "sheet"), 1)] if book is not None else []
        cells: dict = {}
        rows: dict = {}
        for i, sheet in enumerate(names, 1):
            root = _xml(z, f"xl/worksheets/sheet{i}.xml")
            for c in root.iter() if root is not None else ():
                if _local(c) != "c" or not c.get("r"):
                    continue
                v = next((x.text for x in c if _local(x) == "v"), None)
                f = next((x.text for x in c if _local(x) == "f"), None)
                value = shared[int(v)] if c.get("t") == "s" and v else _text(c) if c.get("t") == "inlineStr" else v
                number = _number(value) if c.get("t") not in ("s", "inlineStr", "str") else None
                cells[sheet, c.get("r")] = "=" + f if f else number if number is not None else value
                rows.setdefault((sheet, int(re.sub(r"\D", "", c.get("r")))), []).append((c.get("r"), value))
    values = spreadsheet.Workbook(cells).evaluated()
    for (sheet, row), found in rows.items():
        shown = [f"{cell}={values[sheet, cell][0] if (sheet, cell) in values and values[sheet, cell][1] is None else value}" for cell, value in found if value is not None or (sheet, cell) in values]
        units.put("row", " | ".join(shown), sheet=sheet, row=row)
    for (sheet, cell), (value, error) in values.items():
        units.put("formula", f"{sheet}!{cell} {cells[sheet, cell]} -> {value if error is None else '#' + error}", sheet=sheet, cell=cell)
        units[-1]["metadata"] = {"references": ";".join(f"{s}!{r}" for s, r in spreadsheet.references(cells[sheet, cell][1:], sheet))}


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def pptx(raw: bytes, units: Units) -> None:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            for kind, part in (("shape", name), ("notes", f"ppt/notesSlides/notesSlide{number}.xml")):
                root = _xml(z, part)
                for shape in (e for e in root.iter() if _local(e) == "sp") if root is not None else ():
                    units.put(kind, "\n".join(_text(p) for p in shape.iter() if _local(p) == "p"), slide=number)


def odf(raw: bytes, units: Units) -> None:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = _xml(z, "content.xml")

    def walk(e, sheet=""):
        name = _local(e)
        if name == "table":
            sheet = next((v for k, v in e.attrib.items() if k.endswith("}name")), "")
        if name == "table-row":
            units.put("row", " | ".join(" ".join(c.itertext()).strip() for c in e if _local(c) == "table-cell"), sheet=sheet)
        elif name in ("h", "p"):
            units.put("heading" if name == "h" else "paragraph", "".join(e.itertext()))
        else:
            for child in e:
                walk(child, sheet)

    if root is not None:
        walk(root)


def eml(raw: bytes, units: Units) -> None:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    units.put("header", "\n".join(f"{k}: {message[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if message[k]))
    for n, part in enumerate(message.walk()):
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment":
            units.put("attachment", f"{part.get_filename() or 'attachment'} ({part.get_content_type()})", part=n)
        elif part.get_content_type() == "text/html":
            html_page(part.get_payload(decode=True) or b"", units)
        elif part.get_content_maintype() == "text":
            plain((part.get_payload(decode=True) or b""), units)


def epub(raw: bytes, units: Units) -> None:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(n for n in z.namelist() if re.search(r"\.x?html?$", n)):
            units.put("chapter", name, chapter=name)
            html_page(z.read(name), units)


def pointer(raw: bytes, units: Units) -> None:
    """A shortcut to an online document: its fields only."""
    fields = json.loads(decoded(raw))
    units.put("pointer", " | ".join(f"{k}={fields[k]}" for k in ("url", "doc_id", "resource_id") if k in fields))


def pdf(raw: bytes, units: Units) -> None:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF parser is installed") from e
    for n, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1):
        units.put("page", page.extract_text() or "", page=n)


PARSERS: dict[str, Callable[[bytes, Units], None]] = {
    "txt": plain, "md": plain, "rst": plain, "log": plain, "html": html_page, "htm": html_page, "xhtml": html_page, "json": json_leaves, "jsonl": json_lines, "ndjson": json_lines,
    "csv": table_rows, "tsv": lambda raw, units: table_rows(raw, units, "\t"), "rtf": rtf, "docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odf, "ods": odf, "odp": odf,
    "eml": eml, "epub": epub, "gdoc": pointer, "gsheet": pointer, "gslides": pointer, "pdf": pdf,
}


def parsed(name: str, raw: bytes) -> Units:
    """The units of one file; its extension picks the parser, plain text by default."""
    units = Units()
    try:
        if len(raw) > MOST_BYTES:
            raise ValueError("file too large")
        PARSERS.get(name.rpartition(".")[2].lower(), plain)(raw, units)
    except Exception as e:  # a broken file must not stop the scan
        units.clear()
        units.put("error", f"{type(e).__name__}: {e}"[:500])
    return units


def units_of(files: DataFrame, keys: list[str], name: str, content: str) -> DataFrame:
    """keys and units for files(name, content as bytes)."""
    kinds = dict(files.dtypes)
    columns = [*keys, "kind", "anchor", "text", "title", "parent_anchor", "ordinal", "locator", "metadata"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                values = dict(zip(frame.columns, row, strict=True))
                raw = values[content]
                raw = raw.encode() if isinstance(raw, str) else bytes(raw or b"")
                for u in parsed(str(values[name]), raw):
                    out.append({k: values[k] for k in keys} | u)
                    if len(out) >= HELD:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    own = files.select(*dict.fromkeys([*keys, name, content]))
    return own.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + UNIT)


def scan(spark: SparkSession, folder: str, glob: str = "*", modified_after: str | None = None) -> DataFrame:
    """The files below a folder: path, modificationTime, length, content. Contents are only read where a query needs them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(folder)


def scan_actions(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action): indexed for new and changed files, unchanged, or pruned for known files that are gone."""
    both = listing.select("path", "digest").join(known.select("path", F.col("digest").alias("_d")), "path", "full")
    return both.select("path", F.when(F.col("digest").isNull(), "pruned").when(F.col("_d") == F.col("digest"), "unchanged").otherwise("indexed").alias("action"))


def latest_records(records: DataFrame) -> DataFrame:
    """The last revision of each record (uri, revision, text); a null text deletes it."""
    w = Window.partitionBy("uri").orderBy(F.desc("revision"))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1 and text is not null").drop("_n")


def options_fingerprint(**options) -> str:
    """What decides the extracted content, as one digest."""
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()


def chunked(units: DataFrame, by: list[str], most: int = 6000, least: int = 240, most_units: int = 40, overhead: int = 80) -> DataFrame:
    """(by, chunk, text, units, tokens): consecutive units joined up to ``most`` characters, each counted with an overhead.

    A heading, or a unit under another heading, starts a chunk once the one before has ``least`` characters. A longer unit is
    cut. Units are sorted by document and order, and a task reads them as they come: it holds one chunk and no document.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[str] = []
        key, chunk, size, title, schema = None, 0, 0, None, None

        def close():
            nonlocal size, chunk
            if held:
                text = "\n".join(held)
                out.append((*key, chunk, text, len(held), max(1, len(text) // 4)))
                chunk += 1
            held.clear()
            size = 0

        def passed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

        for b in batches:
            if schema is None:
                kept = [("chunk", pa.int32()), ("text", pa.string()), ("units", pa.int32()), ("tokens", pa.int32())]
                schema = pa.schema([*[b.schema.field(k) for k in by], *[pa.field(*x) for x in kept]])
            for *own, kind, text, heading in zip(*(b.column(c).to_pylist() for c in (*by, "kind", "text", "title")), strict=True):
                if own != key:
                    close()
                    key, chunk, title = own, 0, None
                for i in range(0, max(1, len(text)), most):
                    part = text[i : i + most]
                    if held and (size + len(part) + overhead > most or len(held) >= most_units or ((kind == "heading" or heading != title) and size >= least)):
                        close()
                    held.append(part)
                    size += len(part) + overhead
                title = heading
                if len(out) >= HELD:
                    yield passed()
        if schema is not None:
            close()
            yield passed()

    kinds = dict(units.dtypes)
    ordered = units.select(*by, "kind", "text", "title", "ordinal").repartition(*by).sortWithinPartitions(*by, "ordinal")
    return ordered.mapInArrow(fold, ", ".join(f"{k} {kinds[k]}" for k in by) + ", chunk int, text string, units int, tokens int")


def code_snapshot(events: DataFrame, column: str = "payload") -> dict[str, DataFrame]:
    """The collections of a code graph event (JSON): files, symbols, chunks, lines and edges, each as rows."""
    item = "array<map<string,string>>"
    tree = F.from_json(column, f"repository_id string, revision string, files {item}, symbols {item}, chunks {item}, lines {item}, edges {item}")
    own = events.select(tree.alias("t"))
    return {c: own.select("t.repository_id", "t.revision", F.explode(f"t.{c}").alias("row")) for c in ("files", "symbols", "chunks", "lines", "edges")}
