"""The corpus store under changes and failures: kept counts, recovery, streams, other embedders."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from millrace.operators.corpus import Store
from millrace.operators.lexical import LexicalIndex
from millrace.sources.extract import extract
from millrace.sources.gates import gate
from millrace.streaming.ingest import ingest_stream, stream_files

FILES = "name string, declared_size long, content binary"


def add(spark, store, *files, batch=None):
    return sorted(map(tuple, store.ingest(extract(gate(spark.createDataFrame([(n, None, t.encode()) for n, t in files], FILES))), batch).collect()))


def names(store):
    return sorted(r["name"] for r in store.docs().collect())


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def by_words(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 9)) for r in df.collect())


def test_counts_after_ingests_and_deletes(spark, tmp_path):
    """Term counts, lengths and searches equal those of an index made anew, and statistics read no posting."""
    rng, store = random.Random(2), Store(spark, str(tmp_path / "c"), size=20, overlap=4)
    text = lambda n: " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(n))
    for i in range(3):
        add(spark, store, (f"a{i}.txt", text(150)), (f"b{i}.txt", text(30)), (f"c{i}.txt", ""))
        store.delete(rng.choice(store.docs().where("n_chunks > 0").collect())["sha256"])
    anew, kept = LexicalIndex.build(store.all_chunks(), "id"), store.lexical()
    assert sorted(map(tuple, kept.idf().collect())) == sorted(map(tuple, anew.idf().collect()))
    assert tuple(kept.summary().first()) == tuple(anew.summary().first())
    q = asked(spark, "w1 w2 w40", "w0", "w17 w3 nothing")
    assert by_words(kept.search(q, "query_id", k=5)) == by_words(anew.search(q, "query_id", k=5))
    stats = store.stats()
    assert stats.first()["n_chunks"] == store.all_chunks().count() and not any("/parts/" in f for f in stats.inputFiles())


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    """The folder of a store of two parts."""
    path = tmp_path_factory.mktemp("two") / "c"
    store = Store(spark, str(path))
    add(spark, store, ("a.txt", "frogs live in ponds"))
    add(spark, store, ("b.txt", "trains run on rails"))
    assert store.sound(store.current()) and store.recover() == store.current()
    return path


@pytest.mark.parametrize("damage", ["part", "truncated", "terms", "docs"])
def test_recovery_of_a_damaged_store(spark, two, tmp_path, damage):
    shutil.copytree(two, tmp_path / "c")
    store = Store(spark, str(tmp_path / "c"))
    first = f"{store.path}/v-000000000"
    part = store.docs().where("name = 'b.txt'").first()["part"]
    files = {
        "part": lambda: (tmp_path / f"c/parts/{part}/vectors").glob("*.parquet"), "truncated": lambda: (tmp_path / f"c/parts/{part}/chunks").glob("*.parquet"),
        "terms": lambda: (tmp_path / f"c/terms/{part}").glob("*.parquet"), "docs": lambda: (tmp_path / store.current() / "docs").glob("*.parquet"),
    }[damage]()
    for p in list(files):
        if damage in ("part", "docs"):
            p.unlink()
        else:
            data = p.read_bytes()
            p.write_bytes(data[: len(data) // 2])
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    assert not store.sound(store.current())
    assert store.recover() == first and names(store) == ["a.txt"] and store.current() != first
    if damage == "truncated":
        assert [r["doc"] for r in store.search(asked(spark, "frogs")).where("bm25 > 0").collect()] == ["a.txt"]
        assert add(spark, store, ("b.txt", "trains run on rails"))[0][2] == 200 and names(store) == ["a.txt", "b.txt"]


def test_nothing_sound_is_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    assert store.recover() is None and store.current() is None
    add(spark, store, ("a.txt", "frogs live in ponds"))
    for p in (tmp_path / "c/parts").rglob("*.parquet"):
        p.unlink()
    assert store.recover() is None and names(store) == [] and store.stats().first()["n_chunks"] == 0


def test_a_failed_ingest_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "c"))
    add(spark, store, ("a.txt", "frogs live in ponds"))
    before = store.current()
    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost before the snapshot")))
        with pytest.raises(OSError):
            add(spark, store, ("b.txt", "trains run on rails"))
    assert store.current() == before and names(store) == ["a.txt"] and len(list((tmp_path / "c/parts").iterdir())) == 2
    store.clean()
    assert len(list((tmp_path / "c/parts").iterdir())) == len(list((tmp_path / "c/terms").iterdir())) == 1
    add(spark, store, ("b.txt", "trains run on rails"))
    assert names(store) == ["a.txt", "b.txt"]


def test_a_batch_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    one = add(spark, store, ("a.txt", "frogs live in ponds"), ("b.txt", "frogs live in ponds"), ("c.exe", "x"), batch=("s", 0))
    now = store.current()
    # It comes again, also with other digests: it is known by its number.
    assert add(spark, store, ("a.txt", "frogs live in ponds"), batch=("s", 0)) == one and store.current() == now
    store.delete(store.docs().first()["sha256"])
    assert add(spark, store, ("a.txt", "frogs live in ponds"), batch=("s", 0)) == one and names(store) == []
    two = add(spark, store, ("a.txt", "frogs live in ponds"), batch=("s", 1))
    assert two[0][2] == 200 and add(spark, store, ("z.txt", "zebras"), batch=("other", 0))[0][2] == 200
    store.clean()
    assert add(spark, store, batch=("s", 1)) == two and names(store) == ["a.txt", "z.txt"]
    with pytest.raises(ValueError, match="comes after"):
        add(spark, store, ("a.txt", "x"), batch=("s", 0))


def test_a_stream_broken_off_anywhere(spark, tmp_path, monkeypatch):
    inbox, mark = tmp_path / "in", str(tmp_path / "mark")
    inbox.mkdir()
    store = Store(spark, str(tmp_path / "c"))
    run = lambda: ingest_stream(stream_files(spark, str(inbox)), store, mark, available_now=True).awaitTermination()
    (inbox / "a.txt").write_text("frogs live in ponds")
    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost before the snapshot")))
        with pytest.raises(Exception, match="lost before"):
            run()
    assert names(store) == []
    run()
    now = store.current()
    # The snapshot was made, the stream's own commit was lost.
    for p in (tmp_path / "mark/commits").iterdir():
        p.unlink()
    run()
    assert store.current() == now and names(store) == ["a.txt"]
    (inbox / "b.txt").write_text("trains run on rails")
    run()
    assert names(store) == ["a.txt", "b.txt"]


def by_letters(docs, key):
    """A stand-in for a model: three numbers of a text."""
    n = [F.char_length("text") - F.char_length(F.regexp_replace("text", letter, "")) + F.lit(0.01) for letter in "frt"]
    raw = F.array(*[x.cast("double") for x in n])
    return docs.select(F.col(key).alias("id"), raw.alias("e")).select("id", F.transform("e", lambda x: x / F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, y: a + y * y))).alias("embedding"))


def test_another_embedder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"), embed=by_letters, embedder="letters-1", dim=3)
    add(spark, store, ("a.txt", "ffff ff"), ("b.txt", "tttt tt"))
    hits = store.search(asked(spark, "t", "fff")).where("dense_rank = 1").collect()
    assert {(r["query_id"], r["doc"]) for r in hits} == {(0, "b.txt"), (1, "a.txt")}
    m = store.map(asked(spark, "t"), k=1)
    assert m["points"].count() == 2 and m["queries"].count() == 1 and store.stats().first()["vector_bytes"] == 2 * 3 * 4
    for other in (Store(spark, store.path), Store(spark, store.path, embed=by_letters, embedder="letters-2", dim=3), Store(spark, store.path, embed=by_letters, embedder="letters-1", dim=4)):
        with pytest.raises(ValueError, match="letters-1 with 3"):
            add(spark, other, ("c.txt", "more"))
    store.reset()
    with pytest.raises(ValueError, match="of 4 components"):
        add(spark, Store(spark, store.path, embed=by_letters, embedder="letters-1", dim=4), ("c.txt", "more"))
    assert names(store) == []
    add(spark, Store(spark, store.path), ("c.txt", "more"))
    assert names(store) == ["c.txt"]
