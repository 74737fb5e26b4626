"""Texts of documents: plain text, Markdown, DOCX and PDF, decoded on the workers from Spark's binary files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import distinct_lines

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")
#: A DOCX whose paragraphs and tables have fewer characters is read whole, headers and footers too.
LEAST = 40
NOTHING = {"docx": "no text in the docx: an odd format, text in pictures, or a damaged file", "pdf": "no text in the pdf: perhaps a scan", "": "the file holds no text"}


def plain(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "ignore")


def runs(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{W}t"))


def docx(data: bytes) -> str:
    """Paragraphs of the body, then tables, cells joined by a bar; if that is little, all paragraphs of body, headers and footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist() if re.fullmatch(r"word/(document|header|footer)\w*\.xml", n)}
    body = parts.get("word/document.xml")
    body = body.find(f"{W}body") if body is not None else None
    body = body if body is not None else ElementTree.Element("none")
    lines = [runs(p) for p in body.findall(f"{W}p")]
    lines += [" | ".join(t for c in row.findall(f"{W}tc") if (t := " ".join(filter(None, map(runs, c.findall(f"{W}p")))).strip())) for table in body.findall(f"{W}tbl") for row in table.findall(f"{W}tr")]
    text = "\n".join(x for x in lines if x.strip())
    return text if len(text.strip()) >= LEAST else "\n".join(t for root in parts.values() for p in root.iter(f"{W}p") if (t := runs(p)).strip())


class Pdf:
    """A PDF's objects and the texts of its pages: Flate streams, object streams, text operators, ToUnicode maps."""

    TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]+|[-+.\d]+|[A-Za-z'\"*]+\d*|<<|>>", re.S)
    ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def __init__(self, data: bytes):
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body) and (n := re.search(rb"/N\s+(\d+)", body)) and (first := re.search(rb"/First\s+(\d+)", body)):
                held = self.stream(body)
                heads = [int(x) for x in held[: int(first[1])].split()[: 2 * int(n[1])]]
                starts = [int(first[1]) + at for at in heads[1::2]] + [len(held)]
                self.objects |= {number: held[a:b] for number, a, b in zip(heads[::2], starts, starts[1:])}

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def refs(self, body: bytes, name: bytes) -> list[int]:
        """The objects that an entry names, one or a list."""
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> Iterator[bytes]:
        """Pages in the order of the tree, else of the file."""
        seen, held = set(), [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog", b) for n in self.refs(b, b"Pages")][::-1]
        while held:
            n = held.pop()
            body = self.objects.get(n, b"")
            if n not in seen and re.search(rb"/Type\s*/Page\b", body):
                yield body
            elif n not in seen:
                held += self.refs(body, b"Kids")[::-1]
            seen.add(n)
        if not any(re.search(rb"/Type\s*/Page\b", self.objects.get(n, b"")) for n in seen):
            yield from (b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b))

    def fonts(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Bytes a code and the characters of codes, for fonts that map them."""
        own = page + b"".join(self.objects.get(n, b"") for n in self.refs(page, b"Resources") + self.refs(page, b"Parent"))
        own += b"".join(self.objects.get(n, b"") for n in self.refs(own, b"Font") + self.refs(own, b"Resources"))
        out = {}
        for name, number in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", own):
            for ref in self.refs(self.objects.get(int(number), b""), b"ToUnicode"):
                cmap, known = self.stream(self.objects.get(ref, b"")), {}
                text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
                for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                    known |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
                for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                    for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                        known |= {int(a, 16) + i: text(b"%0*x" % (len(c), int(c, 16) + i)) for i in range(min(int(b, 16) - int(a, 16) + 1, 65536))}
                width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
                out[name] = (len(width[1]) // 2 if width else 1, known)
        return out

    def shown(self, token: bytes, font: tuple[int, dict[int, str]] | None) -> str:
        if token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1]).decode()
            raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
        else:
            raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1][-1:] == b"\n" else self.ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
        if font is None:
            return raw.decode("cp1252", "replace")
        width, known = font
        return "".join(known.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    def text(self, page: bytes) -> str:
        """What a page's text operators show; a move down, or a far step back in a line, begins a line or a word."""
        fonts, font, out, held, y = self.fonts(page), None, [], [], None
        for token in self.TOKEN.findall(b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.refs(page, b"Contents"))):
            if not token[:1].isalpha() and token not in (b"'", b'"'):
                held.append(token)
                continue
            if token in (b"T*", b"'", b'"') or token in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0:
                out.append("\n")
            elif token == b"Tm" and len(held) > 5:
                out.append("\n" if held[-1] != y else " ")
                y = held[-1]
            elif token == b"Td" and out:
                out.append(" ")
            if token == b"Tf" and len(held) > 1:
                font = fonts.get(held[-2])
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                for part in held:
                    if part[:1] in (b"(", b"<") and part not in (b"<<", b">>"):
                        out.append(self.shown(part, font))
                    elif token == b"TJ" and part[:1] == b"-" and part[1:].replace(b".", b"").isdigit() and float(part) < -200:
                        out.append(" ")
            held = []
        return "\n".join(t for t in (" ".join(x.split()) for x in "".join(out).split("\n")) if t)


def pdf(data: bytes) -> str:
    own = Pdf(data)
    return "\n\n".join(t for t in map(own.text, own.pages()) if t)


def decoded(name: str, data: bytes) -> tuple[str, str, str]:
    """Text, extractor and error of a file; what fails gives a blank text and says why."""
    suffix = name.lower().rpartition(".")[2] if "." in name else ""
    extractor = suffix if suffix in ("docx", "pdf") else "bytes"
    try:
        text = {"docx": docx, "pdf": pdf}.get(suffix, plain)(data)
    except Exception as e:  # noqa: BLE001  a damaged file is a row with an error
        return "", extractor, f"{type(e).__name__}: {e}"
    return text, extractor, "" if text.strip() else NOTHING.get(suffix, NOTHING[""])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, suffix, raw_size, modified, extractor, error, text, char_count of the files under a path.

    Text is unified: line ends, blanks, each line once. A file that cannot be read is a row with
    a blank text and an error.
    """

    @F.pandas_udf("text string, extractor string, error string")
    def found(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(p, bytes(c)) for p, c in zip(paths, contents)], columns=["text", "extractor", "error"])

    files = spark.read.format("binaryFile").load(path).withColumn("_found", found("path", "content")).withColumn("text", distinct_lines("_found.text"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select("path", name.alias("file_name"), F.when(name.contains("."), F.lower(F.regexp_extract(name, r"([^.]*)$", 1))).otherwise("").alias("suffix"), F.col("length").alias("raw_size"), F.col("modificationTime").alias("modified"), "_found.extractor", "_found.error", "text", F.length("text").alias("char_count"))


def resume_input(spark: SparkSession, text: str = "", path: str | None = None) -> DataFrame:
    """source, text, char_count, error: the text typed in, else the files under a path, else an error."""
    columns = ["source", "text", "char_count", "error"]
    if text and text.strip():
        return spark.createDataFrame([(text,)], "t string").select(F.lit("text_input").alias("source"), distinct_lines("t").alias("text"), F.lit("").alias("error")).withColumn("char_count", F.length("text")).select(columns)
    if path is None:
        return spark.createDataFrame([("", "", 0, "neither a text nor a file")], "source string, text string, char_count int, error string")
    return read_documents(spark, path).select(F.lit("upload").alias("source"), "text", "char_count", "error")
