"""What operators hold and make, beyond their results."""

import random
import re
from zlib import crc32

import public_tokenizers
import pyarrow as pa

from millrace.llm import op1_bpe, op4_passages


def test_pieces_that_decode_to_themselves_take_no_room():
    with open(public_tokenizers.path(op1_bpe.RANKS), "rb") as f:
        c = op1_bpe.Codec(f.read())
    texts = ["Two words, 12 and naïve.", "", "Two more\n\nwords"]
    first = list(c.texts(texts, True))
    assert c.ids and not c.decoded
    # What decodes to something else still counts as that.
    c.decoded["Two"] = b"2"
    assert [a[2] == b[2] for a, b in zip(first, c.texts(texts, True))] == [False, True, False]


def test_ways_are_made_where_a_chain_has_the_words(spark):
    rows = [(3, [0] * (a + 1), [0] * (b + 1)) for a in range(6) for b in range(6)]
    found = spark.createDataFrame(rows, "n int, lefts array<int>, rights array<int>").where(op4_passages.ENOUGH).selectExpr("size(lefts) - 1 AS a", "size(rights) - 1 AS b", f"{op4_passages.WAYS} AS w").collect()
    assert {(r.a, r.b): r.w for r in found} == {(a, b): w for a in range(6) for b in range(6) if (w := [x for x in range(4) if x <= a and 3 - x <= b])}


def test_stretches_that_overlap_or_adjoin_are_one():
    rng, kind = random.Random(4), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("keeper", pa.int64())]))
    docs = [[{"first": (a := rng.randrange(60)), "last": a + rng.randrange(1, 9), "keeper": rng.choice([None, 0, 1, 2])} for _ in range(rng.randrange(1, 12))] for _ in range(200)]
    (out,) = op4_passages._union([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(docs, kind)], names=["mr_doc", "x"])])
    for x, runs in zip(docs, out.column(1).to_pylist()):
        said = []
        for e in sorted(x, key=lambda e: e["first"]):
            if not said or e["first"] > said[-1][1]:
                said.append([e["first"], e["last"], set()])
            said[-1][1] = max(said[-1][1], e["last"])
            said[-1][2].add(e["keeper"])
        assert [[r["first"], r["last"], set(r["keepers"])] for r in runs] == said
        assert all(len(set(r["keepers"])) == len(r["keepers"]) for r in runs)


def plain_paragraphs(text):
    """The words of each paragraph, sentence by sentence."""
    out, at, words, lower = [], 0, [], text.lower()
    for end in [*(m.end() for m in re.finditer(rb"[.!?][\x20\x09\x0b-\x0d]+|\n+", text)), len(text)]:
        more, at = lower[at:end].split(), end
        if len(more) <= op4_passages.LONG_SENTENCE:
            words += more
            if len(words) >= op4_passages.UNIT_WORDS:
                out.append(words)
                words = []
            continue
        for w in more:
            words.append(w)
            if len(words) >= op4_passages.UNIT_WORDS and (len(words) >= op4_passages.LONG_SENTENCE or crc32(w) % 16 == 0):
                out.append(words)
                words = []
    return [*out, words] if words else out


def test_texts_are_cut_together_as_one_by_one():
    rng = random.Random(1)
    texts = [None, "", " ", "\n"]
    for _ in range(1500):
        texts.append("".join(rng.choice(["a", "Bc", "d.", "!", "\u00c9", "zzz?", " ", "  ", "\n", "\t", "\x0b\n", " w" * rng.choice([1, 1, 50, 70]), ". ", f" w\u00f6rd{rng.randrange(99)}", "\0", " ."]) for _ in range(rng.randrange(90))))
    rng.shuffle(texts)
    lower, starts, ends, bounds = op4_passages._words(pa.array(["before", *texts])[1:])
    cuts, said = op4_passages._cuts(lower, starts, ends, bounds).tolist(), []
    words = [lower[a:b].tobytes() for a, b in zip(starts, ends)]
    for t in texts:
        said += plain_paragraphs((t or "").encode())
    assert [words[a:b] for a, b in zip([0, *cuts], cuts)] == said
    assert bounds.tolist() == [0, *(sum(len((t or "").encode().split()) for t in texts[: i + 1]) for i in range(len(texts)))]
    # Equal words have equal numbers, wherever they stand, also beyond what is hashed at a time; others have others.
    far = [*words, b"x" * (op4_passages.USUAL + 9), *words, b"x" * (op4_passages.USUAL + 9)]
    h = op4_passages._hashes(*op4_passages._words(pa.array([b" ".join(far)]))[:3]).tolist()
    assert len(set(zip(far, h))) == len(set(far)) == len(set(h))


def test_ways_are_made_where_words_are_shared(spark, monkeypatch):
    """One chain asks for 30 words beside it. Of 300 that have the chain some share these, in any way; the others make no keys for it."""
    rng, made = random.Random(5), {}

    def stage(df, label, staged=op4_passages.stage):
        out = staged(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(op4_passages, "stage", stage)
    lefts, rights = ([rng.randrange(1 << 30) for _ in range(43)] for _ in range(2))
    other = lambda n, x: [*x[: n + 1], *(rng.randrange(1 << 30) for _ in range(42 - n))]
    shared = {100 + n: n for n in range(31)}
    contexts = [(0, 9, 20, lefts, rights)] + [(d, 9, 20 + d % 2, other(n, lefts), other(30 - n, rights)) for d, n in shared.items()]
    contexts += [(d, 9, 18, other(0, lefts), other(0, rights)) for d in range(200, 500)]
    met = [(7, d, d if d else 900, at, n, d > 0) for d, at, n, *_ in contexts]
    kind = "mr_doc long, at int, words int, lefts array<int>, rights array<int>"
    chains = spark.createDataFrame(met, "classes long, mr_doc long, doc_id long, at int, words int, goes boolean")
    found = op4_passages._partners(chains, spark.createDataFrame(contexts, kind)).collect()
    assert {(r["first"], r["last"], r["keeper"]) for r in found if r["mr_doc"] == 0} == {(9 - n, 59 - n, d) for d, n in shared.items()}
    # All ways of 332 chains are 10,292; of those that share words two steps at most.
    assert made["op4-ways"] <= 32 * 16
