"""Texts of files, page by page, from the bytes that ``binaryFile`` reads."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.params import IMAGE_EXT, MAX_UPLOAD_BYTES, TEXT_EXT
from millrace.functions.tables import map_texts

PAGES = "array<struct<page:int,text:string>>"
#: A PDF with fewer characters than this is taken for a scan.
SCAN_CHARS = 40
OCR_DPI = 200
#: Bytes that a container may unpack to.
MOST_UNPACKED = 2 * MAX_UPLOAD_BYTES


class Unreadable(Exception):
    """The content doesn't fit its kind; becomes the row's error."""


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, declared_size, content) of the files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("declared_size"), "content")


def decode(content: bytes) -> str:
    """Text by its byte order mark, as UTF-8, by detection if a detector is installed, or as Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        if b"\0" in content:
            raise Unreadable("encoding not recognised") from None
        return content.decode("latin-1")
    best = from_bytes(content).best()
    if best is None:
        raise Unreadable("encoding not recognised")
    return content.decode(best.encoding, "replace")


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable("broken container") from e
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Unreadable("encrypted container")
    if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
        raise Unreadable("container unpacks to more than is accepted")
    return z


def _read(z: zipfile.ZipFile, name: str) -> bytes:
    """One part, whatever size its header says."""
    with z.open(name) as f:
        data = f.read(MOST_UNPACKED + 1)
    if len(data) > MOST_UNPACKED:
        raise Unreadable("container unpacks to more than is accepted")
    return data


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(_read(z, name))
    except (KeyError, ElementTree.ParseError) as e:
        raise Unreadable(f"no readable {name}") from e


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _runs(e: ElementTree.Element, text: str = "t") -> str:
    """The text runs under an element, tabs and breaks as blanks."""
    return "".join((x.text or "") if _local(x) == text else " " if _local(x) in ("tab", "br", "cr") else "" for x in e.iter())


def docx(content: bytes) -> list[tuple[int | None, str]]:
    """Paragraphs outside tables, then all table cells."""
    body = next((x for x in _xml(_open(content), "word/document.xml").iter() if _local(x) == "body"), None)
    if body is None:
        raise Unreadable("no body")
    lines = [_runs(p) for p in body if _local(p) == "p"]
    for t in body:
        if _local(t) == "tbl":
            lines += ["\n".join(_runs(p) for p in cell.iter() if _local(p) == "p") for cell in t.iter() if _local(cell) == "tc"]
    return [(None, "\n".join(lines))]


def odt(content: bytes) -> list[tuple[int | None, str]]:
    root = _xml(_open(content), "content.xml")
    return [(None, "\n".join("".join(p.itertext()) for p in root.iter() if _local(p) in ("p", "h")))]


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx(content: bytes) -> list[tuple[int | None, str]]:
    """A page for each slide, in the order of their numbers."""
    z = _open(content)
    out = []
    for page, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), start=1):
        out.append((page, "\n".join(_runs(p) for p in _xml(z, name).iter() if _local(p) == "p")))
    return out


def xlsx(content: bytes) -> list[tuple[int | None, str]]:
    """A page for each sheet: the cells that aren't blank."""
    z = _open(content)
    shared = [_runs(s) for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for page, name in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), start=1):
        cells = []
        for c in _xml(z, name).iter():
            if _local(c) != "c":
                continue
            value = next((v.text for v in c if _local(v) == "v"), None)
            kind = c.get("t")
            if kind == "s" and value is not None:
                text = shared[int(value)] if value.strip().isdecimal() and int(value) < len(shared) else ""
            elif kind == "inlineStr":
                text = _runs(c)
            else:
                text = value or ""
            if text.strip():
                cells.append(text)
        out.append((page, " ".join(cells)))
    return out


_TAGS = re.compile(r"<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<![^>]*>|<\?[^>]*>|</?[a-z][^>]*>", re.I | re.S)


def html(content: bytes) -> list[tuple[int | None, str]]:
    from html import unescape

    return [(None, unescape(_TAGS.sub(" ", decode(content))))]


def epub(content: bytes) -> list[tuple[int | None, str]]:
    """The documents of the book in the order of its manifest."""
    z = _open(content)
    rootfile = next((x.get("full-path") for x in _xml(z, "META-INF/container.xml").iter() if _local(x) == "rootfile"), None)
    if not rootfile:
        raise Unreadable("no package document")
    base = rootfile.rpartition("/")[0]
    parts = []
    for item in _xml(z, rootfile).iter():
        if _local(item) == "item" and item.get("media-type") in ("application/xhtml+xml", "text/html"):
            name = f"{base}/{item.get('href')}" if base else item.get("href")
            if name in z.namelist():
                parts.append(html(_read(z, name))[0][1])
    return [(None, "\n".join(parts))]


_RTF = re.compile(r"\\'([0-9a-f]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
#: Groups whose text isn't part of the document.
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr themedata datastore listtable generator".split())


def rtf(content: bytes) -> list[tuple[int | None, str]]:
    text = content.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise Unreadable("not RTF")
    out, stack, skip = [], [], False
    for hexed, uni, word, _, symbol, brace, plain in (m.groups() for m in _RTF.finditer(text)):
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word in _RTF_SKIP:
            skip = True
        elif not skip:
            if hexed:
                out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
            elif uni:
                out.append(chr(int(uni) % 65536))
            elif word in ("par", "line", "page", "sect", "row", "tab", "cell"):
                out.append("\n" if word != "tab" and word != "cell" else "\t")
            elif symbol in ("\\", "{", "}"):
                out.append(symbol)
            elif symbol == "~":
                out.append("\xa0")
            elif plain:
                out.append(plain)
    return [(None, "".join(out))]


def pdf(content: bytes) -> list[tuple[int | None, str]]:
    """A page for each page, by whichever reader is installed; a scan goes through OCR if that is."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise Unreadable("no PDF reader is installed") from None
    try:
        pages = [(n, p.extract_text() or "") for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, start=1)]
    except Exception as e:
        raise Unreadable(f"unreadable PDF: {type(e).__name__}") from e
    if sum(len(t.strip()) for _, t in pages) >= SCAN_CHARS:
        return pages
    try:
        import fitz
        import pytesseract
        from PIL import Image
    except ImportError:
        raise Unreadable("a scan, and no OCR is installed") from None
    out = []
    with fitz.open(stream=content, filetype="pdf") as scanned:
        for n, page in enumerate(scanned, start=1):
            image = Image.open(io.BytesIO(page.get_pixmap(dpi=OCR_DPI).tobytes("png")))
            out.append((n, pytesseract.image_to_string(image)))
    return out


def sound_image(content: bytes) -> bool:
    """Whether an image holds together as far as its container says: parts in place and whole, checksums, and what a PNG
    packs. Pixels of other kinds aren't decoded."""
    n = len(content)
    if content.startswith(b"\x89PNG\r\n\x1a\n"):
        at, packed, kinds = 8, zlib.decompressobj(), []
        while at + 12 <= n:
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            if at + 12 + size > n or zlib.crc32(content[at + 4 : at + 8 + size]) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
                return False
            if kind == b"IDAT":
                try:
                    for k in range(at + 8, at + 8 + size, 1 << 16):
                        packed.decompress(content[k : min(k + (1 << 16), at + 8 + size)], 1 << 26)
                except zlib.error:
                    return False
            kinds.append(kind)
            at += 12 + size
        return kinds[:1] == [b"IHDR"] and b"IDAT" in kinds and kinds[-1:] == [b"IEND"]
    if content.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= n and content[at] == 0xFF:
            if content[at + 1] == 0xDA:
                return content.rfind(b"\xff\xd9") > at
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        return False
    if content[:6] in (b"GIF87a", b"GIF89a"):
        return n > 13 and content.rstrip(b"\0").endswith(b";")
    if content.startswith(b"BM"):
        return n >= 26 and int.from_bytes(content[2:6], "little") <= n and 14 < int.from_bytes(content[10:14], "little") < n
    if content[:4] in (b"II*\0", b"MM\0*"):
        at = int.from_bytes(content[4:8], "little" if content[:1] == b"I" else "big")
        return 8 <= at < n - 2
    return content[:4] == b"RIFF" and content[8:12] == b"WEBP" and int.from_bytes(content[4:8], "little") + 8 <= n


def image(content: bytes) -> list[tuple[int | None, str]]:
    try:
        import pytesseract
        from PIL import Image
    except ImportError:
        raise Unreadable("no OCR is installed") from None
    try:
        return [(None, pytesseract.image_to_string(Image.open(io.BytesIO(content)).convert("RGB")))]
    except Exception as e:
        raise Unreadable(f"unreadable image: {type(e).__name__}") from e


def _plain(content: bytes) -> list[tuple[int | None, str]]:
    return [(None, decode(content))]


EXTRACTORS = {
    ".pdf": pdf, ".docx": docx, ".odt": odt, ".pptx": pptx, ".xlsx": xlsx, ".epub": epub, ".rtf": rtf, ".html": html, ".htm": html,
    **dict.fromkeys(TEXT_EXT, _plain), **dict.fromkeys(IMAGE_EXT, image),
}


def extract(files: DataFrame) -> DataFrame:
    """Gated files (ext, content, status, error and more) with pages, array of (page, text), in place of content.

    Content that can't be read, whatever its reader raises, turns status 200 into 422 with its reason, and an image that
    doesn't hold together into 415; other rows have null pages.
    """
    from pyspark.sql import types as T

    names = files.columns
    at = {c: names.index(c) for c in ("ext", "content", "status", "error")}
    keep = [c for c in names if c not in ("content", "status", "error")]
    kind = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            status, error, pages = batch.column(at["status"]).to_pylist(), batch.column(at["error"]).to_pylist(), []
            for i, ext in enumerate(batch.column(at["ext"]).to_pylist()):
                found = None
                if status[i] == 200:
                    try:
                        content = batch.column(at["content"])[i].as_py()
                        if ext in IMAGE_EXT and not sound_image(content):
                            status[i], error[i] = 415, "not a whole image"
                            pages.append(None)
                            continue
                        found = [{"page": p, "text": t.replace("\0", "").encode("utf-8", "replace").decode()} for p, t in EXTRACTORS[ext](content)]
                    except Unreadable as e:
                        status[i], error[i] = 422, str(e)
                    except Exception as e:  # whatever a damaged file makes a reader raise is the file's own fault
                        found, status[i], error[i] = None, 422, f"unreadable: {type(e).__name__}"
                pages.append(found)
            columns = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(status, pa.int32()), pa.array(error, pa.string()), pa.array(pages, kind)], names=[*keep, "status", "error", "pages"])

    fields = [files.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("pages", T._parse_datatype_string(PAGES))])
    return map_texts(files, run, schema)
