"""Gates, extractors, the corpus store and the stream into it."""

import io
import struct
import zipfile
import zlib

import pytest

from millrace.operators import dense
from millrace.operators.corpus import Store, UnknownDocument
from millrace.operators.lexical import LexicalIndex
from millrace.operators.spectral import SpectralMap
from millrace.sources.extract import extract, read_files
from millrace.sources.gates import first_of_digest, gate
from millrace.streaming.ingest import ingest_stream, stream_files

FILES = "name string, declared_size long, content binary"


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_xhtml", ".xhtml").replace("_opf", ".opf"), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = package(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>First para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>last</w:t></w:r></w:p></w:body></w:document>")
ODT = package(content_xml='<o:d xmlns:o="urn:o" xmlns:t="urn:t"><t:h>Title</t:h><t:p>some <t:span>text</t:span></t:p></o:d>')
PPTX = package(ppt__slides__slide2_xml='<sld xmlns:a="urn:a"><a:p><a:r><a:t>two</a:t></a:r></a:p></sld>', ppt__slides__slide1_xml='<sld xmlns:a="urn:a"><a:p><a:r><a:t>one</a:t></a:r></a:p></sld>')
XLSX = package(
    xl__sharedStrings_xml='<sst xmlns="urn:x"><si><t>shared</t></si></sst>',
    xl__worksheets__sheet1_xml='<worksheet xmlns="urn:x"><sheetData><row><c t="s"><v>0</v></c><c><v>42</v></c><c t="inlineStr"><is><t>inline</t></is></c><c/></row></sheetData></worksheet>')
EPUB = package(**{
    "META-INF__container_xml": '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>',
    "O__b_opf": '<package xmlns="urn:p"><manifest><item href="a.xhtml" media-type="application/xhtml+xml"/></manifest></package>',
    "O__a_xhtml": "<html><p>book<b>text</b></p></html>"})
RTF = b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Plain \\b bold\\b0  caf\\'e9\\par next \\u8364?}"


def test_gates(spark):
    rows = [
        ("a.TXT", None, b"x"), ("a.exe", 1, b"x"), ("big.txt", 999, b"x"), ("long.txt", None, b"x" * 60), ("empty.md", 0, b""), ("a.pdf", None, b"no"), ("b.pdf", None, b"%PDF-1.4"),
        ("a.docx", None, b"no"), ("b.docx", None, DOCX[:40]), ("a.png", None, b"no"), ("b.png", None, b"\x89PNG\r\n\x1a\n1"), ("noext", None, b"x"), (".txt", None, b"x"), ("none.txt", None, None),
    ]
    out = {r["name"]: r["status"] for r in gate(spark.createDataFrame(rows, FILES), limit=50).collect()}
    assert out == {"a.TXT": 200, "a.exe": 415, "big.txt": 413, "long.txt": 413, "empty.md": 422, "a.pdf": 415, "b.pdf": 200, "a.docx": 415, "b.docx": 200, "a.png": 415, "b.png": 200, "noext": 415, ".txt": 415, "none.txt": 422}


def test_digests(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, t string")
    known = docs.where("doc_id = 4").select(F.sha2("t", 256).alias("sha256"))
    out = {r["doc_id"]: r["status"] for r in first_of_digest(docs, F.sha2("t", 256), "doc_id", known).collect()}
    assert out == {1: 200, 2: 200, 3: 409, 4: 409}


def test_extractors(spark):
    rows = [
        ("a.txt", "café noir".encode()), ("l.txt", "résumé d'été à la française, très léger".encode("latin-1")), ("u.txt", "wide text".encode("utf-16")),
        ("a.docx", DOCX), ("a.odt", ODT), ("a.pptx", PPTX), ("a.xlsx", XLSX), ("a.epub", EPUB), ("a.rtf", RTF),
        ("a.html", b"<title>T</title><p>x<b>y</b><script>no</script>&amp;</p>"), ("bad.docx", b"PK\x03\x04broken"), ("bad.pdf", b"%PDF-broken"),
    ]
    gated = gate(spark.createDataFrame([(n, None, c) for n, c in rows], FILES))
    out = {r["name"]: r for r in extract(gated).collect()}
    text = {n: [(p["page"], p["text"].split()) for p in r["pages"]] for n, r in out.items() if r["pages"] is not None}
    assert text["a.txt"] == [(None, ["café", "noir"])] and text["u.txt"] == [(None, ["wide", "text"])]
    assert "française," in text["l.txt"][0][1]
    assert text["a.docx"] == [(None, ["First", "para", "last", "cell"])] and text["a.odt"] == [(None, ["Title", "some", "text"])]
    assert text["a.pptx"] == [(1, ["one"]), (2, ["two"])] and text["a.xlsx"] == [(1, ["shared", "42", "inline"])]
    assert text["a.epub"] == [(None, ["book", "text"])] and text["a.rtf"] == [(None, ["Plain", "bold", "café", "next", "€"])]
    assert text["a.html"] == [(None, ["T", "x", "y", "&"])]
    assert out["bad.docx"]["status"] == out["bad.pdf"]["status"] == 422 and out["bad.docx"]["error"]


def damaged(data, at, value=0xFF):
    return data[:at] + bytes([data[at] ^ value]) + data[at + 1 :]


def test_damaged_files_get_a_status(spark):
    """Whatever a reader raises is the file's own row; the others are read."""
    body = b"<w:document"
    encrypted = bytearray(DOCX)
    encrypted[6] |= 1
    encrypted[DOCX.rindex(b"PK\x01\x02") + 8] |= 1
    shared = package(xl__sharedStrings_xml='<sst xmlns="urn:x"><si><t>s</t></si></sst>', xl__worksheets__sheet1_xml='<worksheet xmlns="urn:x"><c t="s"><v>x</v></c><c t="s"><v>-1</v></c><c t="s"><v>9</v></c><c><v>7</v></c></worksheet>')
    rows = [
        ("crc.docx", damaged(DOCX, DOCX.index(body) + 3, 1)), ("encrypted.docx", bytes(encrypted)), ("cut.docx", DOCX[: len(DOCX) // 2]), ("odd.xlsx", shared), ("none.epub", package(a_xml="x")),
        ("xml.odt", package(content_xml="<a><b></a>")), ("good.docx", DOCX), ("bad.rtf", b"no rtf"), ("deep.odt", package(content_xml="<p>" * 3000 + "</p>" * 3000)),
    ]
    out = {r["name"]: r for r in extract(gate(spark.createDataFrame([(n, None, c) for n, c in rows], FILES))).collect()}
    assert {n for n, r in out.items() if r["status"] == 200} >= {"good.docx", "odd.xlsx"} and out["odd.xlsx"]["pages"][0]["text"] == "7"
    for n in ("crc.docx", "encrypted.docx", "cut.docx", "none.epub", "xml.odt", "bad.rtf"):
        assert out[n]["status"] == 422 and out[n]["error"] and out[n]["pages"] is None, n


def png(pixels=b"\0\0", crc=0):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) ^ crc)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


def test_images_that_do_not_hold_together(spark):
    from millrace.sources.extract import sound_image

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9"
    gif, bmp = b"GIF89a" + b"\1\0\1\0\0\0\0" + b",rest;", b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + b"\0" * 44
    tiff, webp = b"II*\0\x08\0\0\0" + b"\0" * 8, b"RIFF" + struct.pack("<I", 8) + b"WEBPVP8 "
    whole = [png(), jpeg, gif, bmp, tiff, webp]
    assert all(map(sound_image, whole))
    assert not any(sound_image(x[: len(x) // 2]) for x in whole) and not sound_image(png(crc=1)) and not sound_image(png().replace(zlib.compress(b"\0\0"), b"damaged!"[: len(zlib.compress(b"\0\0"))]))
    out = {r["name"]: r["status"] for r in extract(gate(spark.createDataFrame([("a.png", None, png()), ("b.png", None, png(crc=1))], FILES))).collect()}
    assert out["b.png"] == 415 and out["a.png"] in (200, 422)  # 422 where no OCR is installed


def test_containers_that_unpack_to_too_much(spark, monkeypatch):
    from millrace.sources import extract as module

    monkeypatch.setattr(module, "MOST_UNPACKED", 100)
    with pytest.raises(module.Unreadable, match="more than is accepted"):
        module.docx(package(word__document_xml="<a>" + " " * 1000 + "</a>"))


def add(spark, store, *files):
    return {r["name"]: r for r in store.ingest(extract(gate(spark.createDataFrame([(n, None, t.encode()) for n, t in files], FILES)))).collect()}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "corpus"))
    assert store.docs().count() == 0 and store.stats().first()["n_chunks"] == 0
    long = " ".join(f"w{i}" for i in range(400))
    out = add(spark, store, ("b.txt", long), ("a.txt", "frogs live in ponds"), ("c.txt", long), ("d.txt", "   \n"), ("e.exe", "x"))
    assert {n: r["status"] for n, r in out.items()} == {"a.txt": 200, "b.txt": 200, "c.txt": 409, "d.txt": 200, "e.exe": 415}
    assert (out["a.txt"]["n_chunks"], out["b.txt"]["n_chunks"], out["d.txt"]["n_chunks"]) == (1, 4, 0)
    again = add(spark, store, ("x.txt", "frogs live in ponds"), ("y.txt", "trains run on rails"))
    assert again["x.txt"]["status"] == 409 and again["y.txt"]["n_chunks"] == 1
    assert [r["id"] for r in store.page(0, 100).collect()] == list(range(6)) and store.chunk(5)["doc"] == "y.txt"
    q = spark.createDataFrame([(1, "frogs ponds")], "query_id long, text string")
    assert store.search(q).where("rank = 1").first()["doc"] == "a.txt"
    assert store.health() == {"ok": True, "chunks": 6}
    for wrong in (lambda: store.page(-1, 5), lambda: store.page(0, 101), lambda: store.search(q, 21)):
        with pytest.raises(ValueError):
            wrong()
    m = store.map(q, k=2)
    assert m["n_total"] == 6 and m["points"].count() == 6 and m["queries"].count() == 1 and m["hits"].count() == 2 and 0 < m["eta"] <= 1
    gone = store.docs().where("name = 'b.txt'").first()["sha256"]
    assert store.delete(gone) == "b.txt"
    assert [(r["id"], r["doc"]) for r in store.page(0, 9).collect()] == [(0, "a.txt"), (1, "y.txt")]
    with pytest.raises(UnknownDocument):
        store.delete(gone)
    # The last document's number is used again, while its part still holds another one.
    last = store.docs().orderBy("doc_no", ascending=False).first()
    assert store.delete(last["sha256"]) == "y.txt"
    add(spark, store, ("z.txt", "zebras cross the road"))
    assert [(r["id"], r["doc"]) for r in store.page(0, 9).collect()] == [(0, "a.txt"), (1, "z.txt")]
    assert store.search(spark.createDataFrame([(1, "zebras"), (2, "trains")], "query_id long, text string")).where("bm25 > 0").select("query_id", "doc").collect() == [(1, "z.txt")]
    kept = store.fitted()
    anew = SpectralMap.fit(dense.hash_embeddings(store.all_chunks(), "id"))
    assert kept.n_rows == anew.n_rows == 2 and kept.eta == pytest.approx(anew.eta) and abs(kept.axes) == pytest.approx(abs(anew.axes), abs=1e-9)
    s = store.stats().first()
    whole = LexicalIndex.build(store.all_chunks(), "id")
    assert (s["n_chunks"], s["vocab_size"], s["index_bytes"]) == (2, whole.summary().first()["vocab_size"], whole.size_bytes().first()[0]) and s["vector_bytes"] == 2 * 384 * 4 and s["report"] is None
    store.clean()
    assert [r["doc"] for r in store.page(0, 9).collect()] == ["a.txt", "z.txt"] and len(list((tmp_path / "corpus").glob("v-*"))) == 1
    store.reset()
    store.clean()
    assert not list((tmp_path / "corpus" / "parts").iterdir())
    assert store.docs().count() == 0 and store.all_chunks().count() == 0 and store.map()["n_total"] == 0


def test_cap_and_failed_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "corpus"), cap=5)
    add(spark, store, ("a.txt", " ".join(f"w{i}" for i in range(500))), ("b.txt", " ".join(f"v{i}" for i in range(500))))
    assert store.stats().first()["capped"] and store.all_chunks().count() == 5
    before = store.current()
    with pytest.raises(Exception):
        store.ingest(spark.createDataFrame([("z", "s", 1, 200, None)], "name string, sha256 string, length long, status int, error string"))
    assert store.current() == before


def test_nothing_is_indexed_twice(spark, tmp_path, monkeypatch):
    """A search reads the kept terms and vectors; an ingest leaves earlier parts as they are."""
    from millrace.operators import corpus

    store = Store(spark, str(tmp_path / "corpus"))
    add(spark, store, ("a.txt", "frogs live in ponds"))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "corpus" / "parts").rglob("*.parquet")}
    add(spark, store, ("b.txt", "trains run on rails"))
    assert {p: p.stat().st_mtime_ns for p in files} == files

    def never(*_, **__):
        raise AssertionError("the corpus is tokenised again")

    monkeypatch.setattr(corpus, "term_counts", never)
    monkeypatch.setattr(corpus, "chunk_words", never)
    monkeypatch.setattr(LexicalIndex, "build", never)
    q = spark.createDataFrame([(1, "frogs"), (2, "trains rails")], "query_id long, text string")
    assert {(r["query_id"], r["doc"]) for r in store.search(q, 1).collect()} == {(1, "a.txt"), (2, "b.txt")}


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = Store(spark, str(tmp_path / "corpus"))
    (inbox / "a.txt").write_text("frogs live in ponds")
    (inbox / "bad.exe").write_text("x")
    ingest_stream(stream_files(spark, str(inbox)), store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    (inbox / "b.txt").write_text("trains run on rails")
    (inbox / "copy.txt").write_text("frogs live in ponds")
    ingest_stream(stream_files(spark, str(inbox)), store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r["name"] for r in store.docs().collect()) == ["a.txt", "b.txt"]
    assert read_files(spark, str(inbox), "*.txt").count() == 3
