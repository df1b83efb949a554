"""The jobs over growing and changing input, on copies; broken off and run again; from the command line."""

import hashlib
import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import answer_questions, index_documents
from millrace.functions.params import NOT_FOUND

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, extra int"


def add(spark, path, *rows):
    """More files in a folder of documents."""
    spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 2}", i) for i, t, lang in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def plain(*batches):
    """{(doc_id, sha256, batch): (status, chunks)} by the rules of the job, document by document."""
    known, out = set(), {}
    for n, rows in enumerate(batches):
        fresh = {}
        for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            h = hashlib.sha256(t.encode()).hexdigest() if t is not None else None
            fresh.setdefault(h, i)
            status = 422 if not t or i is None else 409 if h in known or fresh[h] != i else 200
            w = (t or "").split()
            cut = [(s, " ".join(w[s : s + 150])) for s in range(0, max(1, len(w) - 30), 120)] if w and status == 200 else []
            out[i, h, n] = status, cut
        known |= {h for h in fresh if h}
    return out


def written(spark, docs, out, config=None):
    got = {}
    for r in index_documents.result(spark, docs, out, config).collect():
        status, cut, n = got.setdefault((r["doc_id"], r["sha256"], r["batch"]), (r["status"], [], r["n_chunks"]))
        if r["seq"] is not None:
            cut.append((r["start_word"], r["text"]))
    assert all(n == (len(cut) if status == 200 else None) for status, cut, n in got.values())
    return {k: (status, sorted(cut)) for k, (status, cut, _) in got.items()}


LONG = " ".join(f"w{i}" for i in range(500))
FIRST = [(1, LONG, "en"), (2, "frogs live in ponds", None), (3, LONG, "de"), (4, None, "en"), (5, "", "en"), (6, "  \n", ""), (None, "no key", "en")]
SECOND = [(7, "frogs live in ponds", "en"), (8, "trains run", "d/e =x"), (2, "frogs have moved", "en"), (9, "trains run", "fr")]


def test_only_new_documents_are_taken(spark, tmp_path, caplog):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    add(spark, docs, *FIRST)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with caplog.at_level(logging.INFO):
        index_documents.run(spark, docs, out, mark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert written(spark, docs, out) == plain(FIRST) and "took 7 rows" in caplog.text and "200: 3, 409: 1, 422: 3" in caplog.text
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    add(spark, docs, *SECOND)
    with caplog.at_level(logging.INFO):
        index_documents.run(spark, docs, out, mark)
    assert written(spark, docs, out) == plain(FIRST, SECOND) and "took 4 rows" in caplog.text
    assert {p: p.stat().st_mtime_ns for p in files} == files
    whole = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    index_documents.run(spark, docs, out, mark)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == whole
    langs = {r[0] for r in index_documents.result(spark, docs, out).select("lang").distinct().collect()}
    assert langs == {"en", "de", "none", "d/e =x", "fr"} and (tmp_path / "out/chunks/batch=0/lang=none").is_dir()


def test_a_batch_that_broke_off_is_taken_again(spark, tmp_path, monkeypatch):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    add(spark, docs, *FIRST)
    index_documents.run(spark, docs, out, mark)
    add(spark, docs, *SECOND)
    real = index_documents.kept

    def broken(session, path, schema):
        if path.endswith("chunks"):
            raise RuntimeError("lost between the chunks and the register")
        return real(session, path, schema)

    monkeypatch.setattr(index_documents, "kept", broken)
    with pytest.raises(Exception, match="lost between"):
        index_documents.run(spark, docs, out, mark)
    monkeypatch.setattr(index_documents, "kept", real)
    assert (tmp_path / "out/chunks/batch=1").is_dir() and written(spark, docs, out) == plain(FIRST)
    index_documents.run(spark, docs, out, mark)
    assert written(spark, docs, out) == plain(FIRST, SECOND)
    # A batch whose commit was lost although all of it was written.
    for name in ("1", ".1.crc"):
        (tmp_path / "mark/commits" / name).unlink()
    index_documents.run(spark, docs, out, mark)
    assert written(spark, docs, out) == plain(FIRST, SECOND)


def test_batches_of_files_and_repeated_rows(spark, tmp_path):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    for i, t in enumerate(["one text", "two texts", "one text"]):
        add(spark, docs, (i, t, "en"), (i, t, "en"))
        for p in (tmp_path / "docs").glob("*.parquet"):  # files are taken by their age
            if p.stat().st_mtime > 1e9 + 100:
                os.utime(p, (1e9 + i, 1e9 + i))
    config = {"files_per_batch": 1, "chunk_words": 2, "chunk_overlap": 1, "keep": []}
    index_documents.run(spark, docs, out, mark, config)
    assert {k[0]: (k[2], s) for k, (s, _) in written(spark, docs, out, config).items()} == {0: (0, 200), 1: (1, 200), 2: (2, 409)}


def test_answers_and_their_editions(spark, tmp_path, caplog):
    docs, asked, out = (str(tmp_path / n) for n in ("docs", "asked", "out"))
    add(spark, docs, (1, "Frogs live in ponds and wet grass. They eat flies all day.", "en"), (2, "Trains run on rails through the valley.", "en"), (3, None, "en"))
    questions = [(1, "where do frogs live"), (2, "rails of trains"), (3, "nothing matches zzz"), (4, None)]
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(asked)
    with caplog.at_level(logging.INFO):
        answer_questions.run(spark, docs, asked, out)
    assert "read 3 documents and 4 questions" in caplog.text and "wrote 4 rows" in caplog.text

    def answers(config=None):
        return {r["query_id"]: r for r in answer_questions.result(spark, out, config).collect()}

    first = answers()
    assert first[1]["answer"] == "- Frogs live in ponds and wet grass. [1]" and first[1]["citations"] == [1] and first[1]["doc_id"] == 1
    assert first[2]["doc_id"] == 2 and first[2]["answered"] and not first[3]["answered"] and first[3]["answer"] == first[4]["answer"] == NOT_FOUND and first[3]["n_passages"] == 0
    answer_questions.run(spark, docs, asked, out)
    assert answers() == first
    hybrid = {"edition": "2024-05-01", "mode": "hybrid", "passages": 1}
    answer_questions.run(spark, docs, asked, out, hybrid)
    assert answers() == first and answers(hybrid)[1]["doc_id"] == 1 and answers(hybrid)[3]["n_passages"] == 1
    # An edition is replaced whole, also by fewer answers.
    spark.createDataFrame(questions[2:3], "item_id long, text string").write.mode("overwrite").parquet(asked)
    answer_questions.run(spark, docs, asked, out)
    assert set(answers()) == {3} and set(answers(hybrid)) == {1, 2, 3, 4}
    with pytest.raises(ValueError, match="no such mode"):
        answer_questions.run(spark, docs, asked, out, {"mode": "other"})


def test_command_lines(spark, tmp_path):
    docs, asked = str(tmp_path / "docs"), str(tmp_path / "asked")
    add(spark, docs, (1, "Frogs live in ponds and wet grass.", "en"))
    spark.createDataFrame([(1, "frogs")], "item_id long, text string").write.parquet(asked)
    (tmp_path / "c.json").write_text(json.dumps({"edition": "test", "chunk_words": 4, "chunk_overlap": 1}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for job, args in (("index_documents", ["--checkpoint", str(tmp_path / "mark")]), ("answer_questions", ["--questions", asked])):
        done = subprocess.run([sys.executable, str(ROOT / f"jobs/{job}.py"), "--documents", docs, "--output", str(tmp_path / job), "--config", str(tmp_path / "c.json"), *args], env=env, cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "jobs." in done.stderr
    assert index_documents.result(spark, docs, str(tmp_path / "index_documents")).count() == 2
    assert answer_questions.result(spark, str(tmp_path / "answer_questions"), {"edition": "test"}).first()["doc_id"] == 1


def test_jobs_import_nothing_of_the_pipeline():
    for p in (ROOT / "jobs").glob("*.py"):
        assert "llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
