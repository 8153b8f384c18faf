"""Pages of PDF files as rows, a task for each range of pages.

A file is opened where a task needs it and read by position: the cross-reference tables first (plain ones and compressed streams), then the page tree down
to the page, then that page's content, so no task holds a whole file. Paths are listed by Spark, bytes come through pyarrow's file systems.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text

#: Pages that one task reads.
RANGE = 32
#: Bytes at the end of a file in which its last cross-reference is announced, and that are read at once from there on.
TAIL, STEP = 2048, 4096
PAGES = "doc_name string, page int, text string, extraction_status string"
#: White space and comments; what a word goes on with; bytes that mean something in a string.
_BLANK, _WORD, _MARKS = re.compile(rb"(?:[ \t\r\n\x0c\x00]+|%[^\r\n]*)*"), re.compile(rb"[^ \t\r\n\x0c\x00()<>\[\]{}/%]*"), re.compile(rb"[()\\]")
_NUMERIC, _OCTAL = frozenset(b"0123456789+-."), re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
#: Names that a reference, and an operator of a content stream, are given as.
Ref = tuple  # (number, generation)


class Name(str):
    """/Name"""


class Operator(str):
    """A word that is no value."""


class Lexer:
    """Values of PDF syntax out of bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def space(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def value(self):
        """The next value, or None at the end."""
        self.space()
        d, a = self.data, self.at
        if a >= len(d):
            return None
        two = d[a : a + 2]
        if two == b"<<":
            self.at += 2
            return self.dictionary()
        if two == b">>":
            self.at += 2
            return Operator(">>")
        c = d[a : a + 1]
        if c == b"(":
            return self.string()
        if c == b"<":
            end = d.index(b">", a)
            self.at = end + 1
            digits = re.sub(rb"\s", b"", d[a + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out: list = []
            while (v := self.value()) != "]" or not isinstance(v, Operator):
                if v is None:
                    raise ValueError("an array without an end")
                out.append(v)
                if v == "R" and isinstance(v, Operator) and len(out) > 2:
                    out[-3:] = [Ref((out[-3], out[-2]))]
            return out
        if c in (b"]", b"{", b"}"):
            self.at += 1
            return Operator(c.decode())
        self.at = _WORD.match(d, a + 1).end()
        word = d[a : self.at]
        if c == b"/":
            return Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word[1:]) if b"#" in word else word[1:]).decode("latin-1"))
        if word[0] in _NUMERIC:
            try:
                return float(word) if b"." in word else int(word)
            except ValueError:
                pass
        return word == b"true" if word in (b"true", b"false") else Operator(word.decode("latin-1"))

    def string(self) -> bytes:
        d, out, depth, i = self.data, bytearray(), 1, self.at + 1
        while depth:
            mark = _MARKS.search(d, i)
            if not mark:
                raise ValueError("a string without an end")
            out += d[i : mark.start()]
            i, c = mark.start(), mark[0]
            if c == b"\\":
                i += 1
                e = d[i : i + 1]
                if octal := _OCTAL.match(d, i):
                    out.append(int(octal[0], 8) & 255)
                    i += len(octal[0])
                    continue
                if e in b"\r\n":
                    i += 2 if d[i : i + 2] == b"\r\n" else 1
                    continue
                out += _ESCAPES.get(e, e)
            else:
                depth += (c == b"(") - (c == b")")
                if depth:
                    out += c
            i += 1
        self.at = i
        return bytes(out)

    def dictionary(self) -> dict:
        items: list = []
        while (v := self.value()) != ">>" or not isinstance(v, Operator):
            if v is None:
                raise ValueError("a dictionary without an end")
            if v == "R" and isinstance(v, Operator) and len(items) > 1:
                items[-2:] = [Ref((items[-2], items[-1]))]
            else:
                items.append(None if isinstance(v, Operator) and v == "null" else v)
        return dict(zip(items[::2], items[1::2], strict=False))


class Pdf:
    """An open file, of which only what is asked for is read."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.places: dict[int, tuple] = {}  # number -> ("at", offset) or ("in", number of the object stream, place in it)
        self.streams: dict[int, list] = {}
        self.nodes: dict[tuple, tuple] = {}  # of the page tree, by their way from its root: node, kids, pages up to the end of each kid looked at
        self.maps: dict[int, tuple] = {}  # ToUnicode tables by their numbers
        self.trailer: dict = {}
        tail = self._read(max(0, size - TAIL), TAIL)
        found = tail.rfind(b"startxref")
        if found < 0:
            raise ValueError("no cross-reference")
        at, seen = Lexer(tail, found + 9).value(), set()
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            at = self._section(at)
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")
        if "Root" not in self.trailer:
            raise ValueError("no root")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def _section(self, at: int) -> int | None:
        """Reads one cross-reference section; gives where the one before it is. What was found first stays, as it is newer."""
        if self._read(at, 4) != b"xref":
            return self._compressed(at)
        n = STEP
        while b"startxref" not in (data := self._read(at, n)) and at + n < self.size:
            n *= 4
        x = Lexer(data, 4)
        while isinstance(first := x.value(), int):
            count = x.value()
            for k in range(count):
                offset, _, kind = x.value(), x.value(), x.value()
                if kind == "n":
                    self.places.setdefault(first + k, ("at", offset))
        trailer = x.value()
        self.trailer = trailer | self.trailer
        if isinstance(more := trailer.get("XRefStm"), int):
            self._compressed(more)
        return trailer.get("Prev")

    def _compressed(self, at: int) -> int | None:
        head, data = self._object_at(at)
        if head.get("Type") != "XRef":
            raise ValueError("no cross-reference")
        widths, index = head["W"], head.get("Index") or [0, head["Size"]]
        step, at = sum(widths), 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for k in range(count):
                row, fields, i = data[at : at + step], [], 0
                for w in widths:
                    fields.append(int.from_bytes(row[i : i + w], "big") if w else None)
                    i += w
                kind = 1 if fields[0] is None else fields[0]
                if kind == 1:
                    self.places.setdefault(first + k, ("at", fields[1]))
                elif kind == 2:
                    self.places.setdefault(first + k, ("in", fields[1], fields[2] or 0))
                at += step
        self.trailer = {k: v for k, v in head.items() if k in ("Root", "Encrypt", "Size")} | self.trailer
        return head.get("Prev")

    def _object_at(self, at: int):
        """The object at a position: its value, and the decoded content if it is a stream (else None)."""
        n = STEP
        while True:
            data = self._read(at, n)
            whole = at + n >= self.size
            try:
                x = Lexer(data)
                if not (isinstance(x.value(), int) and isinstance(x.value(), int) and x.value() == "obj"):
                    raise ValueError("no object where the cross-reference has one")
                value = x.value()
                x.space()
                if x.at + 9 < len(data) or whole or not isinstance(value, dict):
                    break
            except (ValueError, IndexError):
                if whole or n > 64 << 20:
                    raise
            n *= 4
        if not isinstance(value, dict) or data[x.at : x.at + 6] != b"stream":
            return value, None
        start = at + x.at + 6
        start += 2 if data[x.at + 6 : x.at + 8] == b"\r\n" else 1
        return value, self._decoded(value, self._read(start, self.get(value["Length"])))

    def _decoded(self, head: dict, data: bytes) -> bytes:
        filters = self.get(head.get("Filter")) or []
        filters = filters if isinstance(filters, list) else [filters]
        parameters = self.get(head.get("DecodeParms")) or {}
        parameters = parameters if isinstance(parameters, list) else [parameters]
        for k, name in enumerate(filters):
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name}")
            data = zlib.decompressobj().decompress(data)
            p = (parameters[k] if k < len(parameters) else None) or {}
            if p.get("Predictor", 1) >= 10:
                data = _unpredicted(data, p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8)
            elif p.get("Predictor", 1) != 1:
                raise ValueError("predictor")
        return data

    def get(self, v):
        """A value, followed where it is a reference."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.object(v[0])[0]
        raise ValueError("references in a circle")

    def object(self, number: int):
        place = self.places.get(number)
        if place is None:
            return None, None
        if place[0] == "at":
            return self._object_at(place[1])
        if place[1] not in self.streams:
            head, data = self.object(place[1])
            x = Lexer(data[: head["First"]])
            starts = [(x.value(), x.value()) for _ in range(head["N"])]
            self.streams[place[1]] = [Lexer(data, head["First"] + offset).value() for _, offset in starts]
        return self.streams[place[1]][place[2]], None

    def content(self, v) -> bytes:
        """The decoded bytes of a stream, or of several, one after the other."""
        if isinstance(v, Ref):
            value, data = self.object(v[0])
            return data if data is not None else self.content(value)
        return b"\n".join(self.content(x) for x in v or [])

    def pages(self) -> int:
        return self.get(self.get(self.get(self.trailer["Root"])["Pages"])["Count"])

    def page(self, k: int) -> dict:
        """The k-th page from 0 with what it inherits: down the tree, past what comes before by its count. What lies on the way is read once, however many pages are asked for."""
        inherited, way, at = {}, (), self.trailer["Root"]
        for _ in range(64):
            if way not in self.nodes:
                node = self.get(at) if way else self.get(self.get(at)["Pages"])
                if node.get("Type") == "Page" or "Kids" not in node:
                    return inherited | node
                self.nodes[way] = (node, self.get(node["Kids"]), [])
            node, kids, ends = self.nodes[way]
            inherited |= {x: node[x] for x in ("Resources",) if x in node}
            while len(ends) < len(kids) and (not ends or ends[-1] <= k):
                kid = self.get(kids[len(ends)])
                ends.append((ends[-1] if ends else 0) + (self.get(kid["Count"]) if "Kids" in kid else 1))
            i = bisect_right(ends, k)
            if i == len(ends):
                raise IndexError("no such page")
            at, way, k = kids[i], (*way, i), k - (ends[i - 1] if i else 0)
        raise ValueError("a page tree without an end")

    def text(self, k: int) -> str:
        page = self.page(k)
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps = {name: self._unicode(self.get(font)) for name, font in fonts.items()}
        return shown(self.content(page.get("Contents")), maps)

    def _unicode(self, font: dict) -> tuple[int, dict[int, str]]:
        """(bytes of a code, what codes mean); without a table of its own a font has the Windows code page."""
        if isinstance(table := font.get("ToUnicode"), Ref):
            if table[0] not in self.maps:  # pages share their fonts
                self.maps[table[0]] = cmap(self.content(table))
            return self.maps[table[0]]
        if font.get("Subtype") == "Type0":
            raise ValueError("a composite font without a table")
        return 1, {}


def _unpredicted(data: bytes, width: int) -> bytes:
    """Rows of a PNG predictor: each begins with its filter. None, sub and up occur in cross-references."""
    out, before = bytearray(), bytearray(width)
    for a in range(0, len(data), width + 1):
        kind, row = data[a], bytearray(data[a + 1 : a + 1 + width])
        for i in range(len(row)):
            if kind == 1:
                row[i] = (row[i] + (row[i - 1] if i else 0)) & 255
            elif kind == 2:
                row[i] = (row[i] + before[i]) & 255
            elif kind:
                raise ValueError("predictor")
        out += row
        before = row
    return bytes(out)


def cmap(data: bytes) -> tuple[int, dict[int, str]]:
    """The codes of a ToUnicode table."""
    width, out, values, x = 1, {}, [], Lexer(data)
    text = lambda b: b.decode("utf-16-be", "replace")
    while (v := x.value()) is not None:
        if not isinstance(v, Operator):
            values.append(v)
            continue
        if v == "endcodespacerange" and values:
            width = len(values[-1])
        elif v == "endbfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(values[::2], values[1::2], strict=True)}
        elif v == "endbfrange":
            for lo, hi, to in zip(values[::3], values[1::3], values[2::3], strict=True):
                a = int.from_bytes(lo, "big")
                for k in range(int.from_bytes(hi, "big") - a + 1):
                    out[a + k] = text(to[k]) if isinstance(to, list) else text(to)[:-1] + chr(ord(text(to)[-1]) + k)
        values = []
    return width, out


def shown(content: bytes, fonts: dict[str, tuple[int, dict[int, str]]]) -> str:
    """The text that a content stream shows, in its order; moves to another line end lines, and wide gaps between pieces of a line are blanks."""
    out: list[str] = []
    font, values, x = (1, {}), [], Lexer(content)

    def put(piece: bytes) -> None:
        width, table = font
        if not table and width == 1:
            out.append(piece.decode("cp1252", "replace"))
            return
        codes = [int.from_bytes(piece[i : i + width], "big") for i in range(0, len(piece), width)]
        out.append("".join(table.get(c) or (bytes([c]).decode("cp1252", "replace") if c < 256 else "�") for c in codes))

    while (v := x.value()) is not None:
        if not isinstance(v, Operator):
            values.append(v)
            continue
        if v == "Tf" and len(values) > 1:
            font = fonts.get(values[-2], (1, {}))
        elif v == "Tj" and values:
            put(values[-1])
        elif v in ("'", '"') and values:
            out.append("\n")
            put(values[-1])
        elif v == "TJ" and values:
            for p in values[-1]:
                if isinstance(p, bytes):
                    put(p)
                elif p < -200:
                    out.append(" ")
        elif v in ("T*", "ET") or (v in ("Td", "TD") and len(values) > 1 and values[-1] != 0) or v == "Tm":
            out.append("\n")
        elif v == "BI":  # an inline image
            end = re.compile(rb"\sEI\s").search(content, x.at)
            x.at = end.end() if end else len(content)
        values = []
    return "".join(out)


def _open(path: str):
    """(file, size) of a path as Spark lists it."""
    from pyarrow import fs

    at = urlparse(path)
    store, name = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    return store.open_input_file(name), store.get_file_info(name).size


def create(path: str, data: bytes) -> None:
    """A new file at a path of any store; its folder is made."""
    from pyarrow import fs

    at = urlparse(path)
    store, name = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as out:
        out.write(data)


def _name(path: str) -> str:
    return unquote(path.rsplit("/", 1)[-1]).rsplit(".", 1)[0]


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """path (a file, folder or pattern) -> path, pages, error: what each file says of itself; the contents of pages are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    file, size = _open(p)
                    with file:
                        n = Pdf(file, size).pages()
                    rows.append((p, int(n), None) if n else (p, None, "ValueError: no pages"))
                except Exception as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"]).astype({"pages": "Int32"})

    listed = spark.read.format("binaryFile").load(path).select("path")
    return listed.mapInPandas(run, "path string, pages int, error string")


def read_pages(spark: SparkSession, path: str, pages: int = RANGE) -> DataFrame:
    """path -> doc_name (the file's name), page (from 0), text, extraction_status: ok, empty (no text on the page) or error:<kind>, with an empty text. A file that cannot be opened is one
    row without a page; files without a byte are not listed. A task reads `pages` neighbouring pages, so one long document is read by many; blank pages are never left out."""
    first = F.when(F.col("error").isNull(), F.sequence(F.lit(0), F.col("pages") - 1, F.lit(pages))).otherwise(F.array(F.lit(None).cast("int")))
    ranges = page_counts(spark, path).select("path", "pages", "error", F.explode(first).alias("first"))
    # A number of its own: rows of a few bytes that stand for much work would else be put together into one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, n, error, first in zip(b["path"], b["pages"], b["error"], b["first"], strict=True):
                rows: list[tuple] = []
                if isinstance(error, str):
                    rows.append((_name(p), None, None, f"error:{error}"))
                else:
                    file, size = _open(p)
                    with file:
                        pdf = Pdf(file, size)
                        for k in range(int(first), min(int(n), int(first) + pages)):
                            try:
                                rows.append((_name(p), k, pdf.text(k), None))
                            except Exception as e:
                                rows.append((_name(p), k, "", f"error:{type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["doc_name", "page", "text", "failed"]).astype({"page": "Int32"})

    made = ranges.repartition(tasks, "path", "first").mapInPandas(run, "doc_name string, page int, text string, failed string")
    cleaned = made.select("doc_name", "page", clean_text(F.col("text")).alias("text"), "failed")  # once, not for each use of it
    return cleaned.select("doc_name", "page", "text", F.coalesce("failed", F.when(F.col("text") == "", "empty").otherwise("ok")).alias("extraction_status"))


def write_pdf(pages: list[str], compressed: bool = False) -> bytes:
    """A PDF of text pages, one line of the text a line, in the Windows code page (other characters through a table of their own). compressed: its objects and
    cross-reference are compressed streams. Round trips and examples are made with it."""
    other = sorted(set().union(*pages) - _IN_PAGE - {"\n"})
    if len(other) > 65000:
        raise ValueError("too many characters that the code page lacks")
    wide = {c: k + 1 for k, c in enumerate(other)}
    table = "1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "".join(f"1 beginbfchar <{k:04X}> <{c.encode('utf-16-be').hex()}> endbfchar\n" for c, k in wide.items())
    bodies: list[tuple[str, bytes | None]] = [("<< /Type /Catalog /Pages 2 0 R >>", None), ("", None), ("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", None)]
    bodies += [("<< /Type /Font /Subtype /Type0 /BaseFont /Other /ToUnicode 5 0 R >>", None), ("", table.encode())]
    kids = []
    for t in pages:
        shows = []
        for line in t.split("\n") if t else []:
            for run in _RUNS.findall(line):
                if run[0] in _IN_PAGE:
                    shows.append(b"/F1 9 Tf (" + re.sub(rb"([()\\])", rb"\\\1", run.encode("cp1252")).replace(b"\r", b"\\r") + b") Tj")
                else:
                    shows.append(b"/F2 9 Tf <" + b"".join(b"%04x" % wide[c] for c in run) + b"> Tj")
            shows.append(b"T*")
        bodies.append(("", b"BT 10 TL 40 800 Td\n" + b"\n".join(shows) + b"\nET"))
        kids.append(len(bodies) + 1)
        bodies.append((f"<< /Type /Page /Parent 2 0 R /Contents {len(bodies)} 0 R >>", None))
    bodies[1] = (f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>", None)
    return _assembled(bodies, compressed)


#: What the Windows code page has, apart from ends of lines; runs of a line that are all in it, or all not.
_IN_PAGE = frozenset(bytes(range(256)).decode("cp1252", "ignore")) - {"\n"}
_RUNS = re.compile("[{0}]+|[^{0}]+".format(re.escape("".join(sorted(_IN_PAGE)))))


def _stream(head: str, data: bytes) -> bytes:
    data = zlib.compress(data)
    return f"<< {head} /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream"


def _assembled(bodies: list[tuple[str, bytes | None]], compressed: bool) -> bytes:
    out, places, packed = bytearray(b"%PDF-1.5\n"), {}, []
    for k, (text, data) in enumerate(bodies, 1):
        if compressed and data is None:
            packed.append((k, text.encode()))
            continue
        places[k] = ("at", len(out))
        out += f"{k} 0 obj\n".encode() + (_stream("", data) if data is not None else text.encode()) + b"\nendobj\n"
    n = len(bodies)
    if not compressed:
        start = len(out)
        out += f"xref\n0 {n + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{places[k][1]:010d} 00000 n \n".encode() for k in range(1, n + 1))
        return bytes(out) + f"trailer\n<< /Size {n + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    heads, body = [], b""
    for k, text in packed:
        heads.append(f"{k} {len(body)}")
        body += text + b"\n"
    index = (" ".join(heads) + "\n").encode()
    places[n + 1] = ("at", len(out))
    out += f"{n + 1} 0 obj\n".encode() + _stream(f"/Type /ObjStm /N {len(packed)} /First {len(index)}", index + body) + b"\nendobj\n"
    places |= {k: ("in", n + 1, i) for i, (k, _) in enumerate(packed)}
    places[n + 2] = ("at", len(out))
    rows = [b"\x00" * 7] + [bytes([1]) + places[k][1].to_bytes(4, "big") + b"\x00\x00" if places[k][0] == "at" else bytes([2]) + places[k][1].to_bytes(4, "big") + places[k][2].to_bytes(2, "big") for k in range(1, n + 3)]
    start, before, filtered = len(out), bytes(7), b""
    for row in rows:  # rows as differences to the one above
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True))
        before = row
    out += f"{n + 2} 0 obj\n".encode() + _stream(f"/Type /XRef /Size {n + 3} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>", filtered) + b"\nendobj\n"
    return bytes(out) + f"startxref\n{start}\n%%EOF\n".encode()
