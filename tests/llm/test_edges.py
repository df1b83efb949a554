"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import zlib

import pytest

from millrace.llm.op1_bpe import decode, encode
from millrace.llm.op2_simhash import near_dedup, simhash_groups
from millrace.llm.op3_preferences import format_preferences, pair_conversations
from millrace.llm.op4_passages import drop_repeats, repeats
from millrace.llm.op5_vectors import vector_groups
from millrace.llm.op6_quality import quality_filter, verdicts
from millrace.llm.op7_sharding import shard
from millrace.llm.op8_html import extract
from millrace.llm.op9_counts import Ledger, signed, with_token_counts
from millrace.llm.op10_mixing import mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of" for i in range(60_000)) + "."
ROWS = [
    (1, "one two three four five", "en", "a", 23), (2, None, "en", "a", None), (3, "", None, "a", 0), (None, "one two three four five", "en", None, 23),
    (4, "  \t\n ", "en", "b", 5), (5, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)), (6, LONG, None, None, len(LONG)),
    (None, None, None, None, None), (7, "日本語 Ünïcode 😀 \x00 end", "xx", "c", 20), (7, "another text with the same id", "xx", "c", 20), (-8, "one two three four five", "en", "a", 23),
]
#: Names that operators give to what they add.
CLASH = ["size", "shard", "slot", "law", "grown_shard", "text_crc32", "copy_no", "n_copies", "shuffle_key", "n_words", "kept", "base_failed", "component_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "n", "key", "a", "b", "id", "root", "unit", "words", "seq", "node", "mr_fp", "mr_doc", "MR_D", "mr_rate", "mr_h", "mr_lang", "mr_removed", "rate", "n_lines"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in ROWS], DOCS + "".join(f", {c} string" for c in CLASH))


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_bpe(request, which):
    df = request.getfixturevalue(which)
    out = encode(df).collect()
    assert len(out) == len(ROWS)
    for r in out:
        if r["n_tokens"] == 0:
            assert r["ids"] == [] and r["ids_sha256"] == r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert sorted(r["decoded_sha256"] for r in out) == texts
    back = decode(encode(df).select("ids")).collect()
    assert sorted(hashlib.sha256(r["decoded"]).hexdigest() for r in back) == texts


def test_bpe_empty_and_null_ids(spark, none):
    assert encode(none).count() == 0
    rows = decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()
    assert sorted(rows, key=str) == sorted([(None,), (bytearray(),)], key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_simhash(request, which):
    out = simhash_groups(request.getfixturevalue(which)).collect()
    assert len(out) == len(ROWS)
    blank = {r["component_id"] for r in out if r["mr_fp"] == 0}
    assert blank == {2}  # null, empty and blank texts, linked with each other
    same = {r["component_id"] for r in out if r["doc_id"] in (1, -8) or r["doc_id"] is None and r["mr_fp"] != 0}
    assert same == {-8}
    assert {r["component_id"] for r in out if r["doc_id"] in (5, 6)} == {5}


def test_simhash_dedup(docs, clashing, none):
    for df in (docs, clashing):
        out = near_dedup(df)
        assert out.columns == df.columns
        kept = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None and r["text"])
        assert [k for k, _ in kept] == [-8, 5, 7, 7]
        assert out.count() == 5  # and one of the texts without words
    assert near_dedup(none).count() == 0 and simhash_groups(none).count() == 0


def test_null_ids_only(spark):
    df = spark.createDataFrame([(None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash_groups(df).collect()] == [None, None]
    assert near_dedup(df).count() == 1


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_passages(request, which):
    df = request.getfixturevalue(which)
    out = drop_repeats(df)
    assert out.columns == [*[c for c in df.columns if c != "mr_removed"], "mr_removed"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["text"] == LONG and r["mr_removed"] == 0 for r in by[5])
    assert by[6][0]["mr_removed"] > 100_000 and by[6][0]["n_chars"] == len(by[6][0]["text"])
    assert by[2][0]["text"] is None and by[3][0]["text"] == ""


def test_passages_empty(none):
    assert drop_repeats(none).count() == 0 and repeats(none).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    v = [1.0, 0.0, 0.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 0.0, 0.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 0.0], 1),
        (10, [nan, 0.0, 1.0], 1), (11, [inf, 0.0, 0.0], 1), (None, v, 1), (12, [1.0, 0.0], 1), (13, [0.93, (1 - 0.93**2) ** 0.5 * 1.01, 0.0], 1), (14, [0.94, (1 - 0.94**2) ** 0.5, 0.0], 1), (1, v, 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, n_links string, id string")
    out = vector_groups(df).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    # Five copies of two directions and one at a cosine of 0.94: 1, 1, 2, 3, null, 14; 13 is just below for v, and links with 14.
    assert got[1] == [(5, 1, True)] * 2 and got[2] == [(5, 1, False)] and got[3] == [(5, 1, False)] and got[None] == [(5, 1, False)]
    assert got[14] == [(6, 1, False)] and got[13] == [(1, 1, False)]
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[k] == [(0, k, True)], k
    assert vector_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_quality(request, which):
    df = request.getfixturevalue(which)
    out = verdicts(df).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert [r["n_words"] for r in out if r["doc_id"] in (2, 3, 4)] == [0, 0, 0]
    assert quality_filter(df).columns == df.columns


def test_quality_empty(none):
    assert verdicts(none).count() == 0 and quality_filter(none).count() == 0


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    out = shard(df, 4).collect()
    assert len(out) == len(ROWS) and {r["law"] for r in out} == {"bytes"}
    for r in out:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["grown_shard"] is None and 0 <= r["shard"] < 4
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_empty_and_one(spark, none):
    assert shard(none).count() == 0
    one = shard(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_html(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (3, "plain"), (3, "plain"), (4, "<div>" * 3000 + "deep"), (5, "<table><tr><td>" * 300 + "in"), (6, "<p>" + "y " * 200_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, html string, text string")
    out = extract(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[1] == got[2] == "" and got[None] == "x" and got[3] == "plain" and got[4] == "deep" and got[5] == "in" and len(got[6]) == 399_999
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_token_counts(request, which):
    import public_tokenizers

    out = with_token_counts(request.getfixturevalue(which), {"v": public_tokenizers.path("byte_bpe_50k.tiktoken")}).collect()
    assert len(out) == len(ROWS) and all(r["n_v"] == 0 for r in out if r["doc_id"] in (2, 3))


def test_ledger(spark, tmp_path):
    kind = "op string, source string, lang string, version string, n_tokens long, old_tokens long"
    led = Ledger(spark, str(tmp_path / "ledger"))
    assert led.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "1", 10, None), ("insert", "a", "en", "1", None, None), ("insert", None, None, None, 5, None)], kind)
    assert led.commit("b1", first) and not led.commit("b1", first)
    assert led.commit("b2", spark.createDataFrame([("revise", "a", "en", "1", 7, 10), ("delete", None, None, None, 5, None)], kind))
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 2, 7)]
    assert led.fold()
    assert led.batches() == ["b1", "b2"] and not led.commit("b2", first)
    assert led.commit("b3", spark.createDataFrame([], kind))
    assert led.commit("b4", spark.createDataFrame([("insert", "a", "en", "1", 3, None)], kind))
    led.fold()
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 3, 10)]
    with pytest.raises(Exception, match="insert, delete or revise"):
        signed(spark.createDataFrame([("other", "a", "en", "1", 3, None)], kind)).collect()
    with pytest.raises(ValueError):
        led.commit("../x", first)


def test_ledger_while_it_folds(spark, tmp_path):
    """A batch that is committed inside a fold, before and after its rows are summed, counts once; so does one whose second commit
    comes between the looks and the file of the first; the loser of two folds changes nothing."""
    kind = "op string, source string, lang string, version string, n_tokens long, old_tokens long"
    add = lambda n: spark.createDataFrame([("insert", "a", "en", "1", n, None)], kind)
    path = str(tmp_path / "ledger")
    led = Ledger(spark, path)
    led.commit("b1", add(5))

    class Interrupted(Ledger):
        def _sum(self, base, names):
            led.commit("b2", add(10))
            out = super()._sum(base, names)
            led.commit("b3", add(20))
            return out

        def _put(self, folder, name):
            if name == "batch-b4":
                assert led.commit("b4", add(40))
            return super()._put(folder, name)

    other = Interrupted(spark, path)
    assert other.fold()
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 3, 35)] and led.batches() == ["b1", "b2", "b3"]
    assert not other.commit("b4", add(40))
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 4, 75)]

    class Raced(Ledger):
        def _put(self, folder, name):
            assert led.fold()
            return super()._put(folder, name)

    assert not Raced(spark, path).fold()
    assert led.fold() and led.batches() == ["b1", "b2", "b3", "b4"]
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 4, 75)]
    led.remove()
    assert not (tmp_path / "ledger").exists()


def test_ledger_of_a_batch_that_was_folded_meanwhile(spark, tmp_path):
    """The second commit of a batch says that it did nothing, though the file of the first is gone again; what broken-off
    writers leave is removed, and nothing else."""
    kind = "op string, source string, lang string, version string, n_tokens long, old_tokens long"
    add = lambda n: spark.createDataFrame([("insert", "a", "en", "1", n, None)], kind)
    led = Ledger(spark, str(tmp_path / "ledger"))

    class Late(Ledger):
        def _put(self, folder, name):
            if name.startswith("batch-"):
                assert led.commit("b1", add(5)) and led.fold()
            return super()._put(folder, name)

    assert not Late(spark, led.path).commit("b1", add(5))
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 1, 5)]

    class Dies(Ledger):
        def _put(self, folder, name):
            raise OSError("lost before the rename")

    with pytest.raises(OSError):
        Dies(spark, led.path).commit("b2", add(7))
    assert led.commit("b3", add(20))
    left = {p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")}
    led.clean()
    kept = {p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")}
    assert len(left) == len(kept) + 1 and kept < left and led.batches() == ["b1", "b3"]
    assert [tuple(r) for r in led.totals().collect()] == [("a", "en", "1", 2, 25)]


def test_mixing_with_large_tables(docs, monkeypatch):
    """Tables beyond the size that is broadcast give the same rows."""
    small = sorted(map(str, mix(docs, budget=3000).drop("kept").collect()))
    monkeypatch.setattr("millrace.llm.op10_mixing.BROADCAST_BYTES", 0)
    out = mix(docs, budget=3000)
    assert sorted(map(str, out.drop("kept").collect())) == small and "mr_salt" not in out.columns


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = mix(df, {"a": 1, "b": 2, None: 1, "gone": 5}).collect()
    assert {r["source"] for r in rows} <= {"a", "b", None}
    order = [(r["shuffle_key"]) for r in rows]
    assert order == sorted(order)
    for r in rows:
        assert 0 <= r["copy_no"] < r["n_copies"]


def test_mixing_empty(none):
    assert mix(none).count() == 0 and mix(none, {"a": 1}).count() == 0


@pytest.mark.parametrize("which", ["docs", "clashing", "none"])
def test_pipeline(spark, request, tmp_path, which):
    """The whole pipeline on nulls, long and repeated texts, clashing columns, and an empty table."""
    import corpus_pipeline

    df = request.getfixturevalue(which)
    good = " ".join(f"word{i}" for i in range(80)) + "."
    if which != "none":
        more = spark.createDataFrame([(100, good, "en", "a", 1), (101, good, None, None, None), (None, "other " + good, "en", None, 1), (102, good.replace("word1", "x"), "en", "a", 1)], DOCS)
        df = df.unionByName(more, allowMissingColumns=True)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if which == "none":
        assert out == []
    else:
        assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)


def test_preferences(spark):
    kind = "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    u, a, b = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    rows = [([u, a], [u, b], "x"), ([u, a], [u, a], "x"), ([u], [u, b], "x"), (None, [u], "x"), ([], None, "x"), ([(None, None), a], [("user", ""), b], "x")]
    out = format_preferences(spark.createDataFrame(rows, kind)).collect()
    assert [r["n_shared"] for r in out] == [1, 2, 1, 0, 0, 1]
    r = out[0]
    assert r["prompt"] == "<|user|>\nq\n<|end|>\n" and r["chosen_completion"] == "<|assistant|>\nyes\n<|end|>\n"
    (m,) = r["chosen_mask"]
    assert r["chosen_completion"][m["start"] : m["end"]] == "yes\n<|end|>\n"
    assert out[1]["chosen_completion"] == out[1]["rejected_completion"] == "" and out[2]["chosen_completion"] == ""
    turns = spark.createDataFrame([(None, 0, "user", "q"), (1, 0, "user", "q"), (1, None, None, None), (2, 0, "user", "q"), (2, 0, "user", "q"), (3, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    pairs = pair_conversations(turns).collect()
    assert sorted((c for r in pairs for c in (r["chosen_id"], r["rejected_id"]) if c is not None)) == [1, 2, 3]
    assert pair_conversations(turns.limit(0)).count() == 0
    clash = turns.selectExpr("*", *[f"'x' AS {c}" for c in ("turns", "opening", "at", "pair", "other", "borrowed", "mr_c")])
    assert sorted(map(str, pair_conversations(clash).collect())) == sorted(map(str, pairs))
    named = spark.createDataFrame([([u, a], [u, b], "x", "y", 7)], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, MR_C string, mr_p string, n_shared int")
    (r,) = format_preferences(named).collect()
    assert (r["MR_C"], r["mr_p"], r["n_shared"]) == ("x", "y", 1)
