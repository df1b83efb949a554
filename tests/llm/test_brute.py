"""Every operator against a plain version without Spark, or against planted cases."""

import base64
import decimal
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__
import corpus_pipeline
from millrace.llm import op1_bpe, op2_simhash, op3_preferences, op4_passages, op5_vectors, op6_quality, op10_mixing
from millrace.llm.components import components
from millrace.llm.golay import fuzzy_keys
from millrace.llm.op3_preferences import pair_conversations
from millrace.llm.op8_html import html_to_text


def load(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def query(spark, sf, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, sf).collect()]


def encoding(name):
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_bpe_equals_the_library(spark, sf):
    docs, enc = {d["doc_id"]: d["text"] for d in load(spark, sf, "documents")}, encoding("byte_bpe_50k")
    out = query(spark, sf, "op1_bpe")
    assert len(out) == len(docs)
    for r in out:
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_odd_texts():
    enc = encoding("byte_bpe_50k")
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 2000, "".join(rng.choice("etaoin") for _ in range(2000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(3000)), " \n\t " * 200, "日本" * 300, "I'll we've 'S  x"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = op1_bpe.Codec(f.read())
    for t, (n, _, decoded, ids) in zip(texts, codec.texts(texts, True)):
        assert list(ids) == enc.encode_ordinary(t) and n == len(ids) and decoded == hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return op1_bpe.Codec(f.read())


def test_bpe_classes_are_the_library_s(codec):
    """Every code point that the two libraries class differently, and others, beside letters, digits and themselves."""
    enc, rng = encoding("byte_bpe_50k"), random.Random(21)
    odd = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and codec.odd and codec.odd.match(c)]
    chars = odd + [chr(rng.randrange(128, 0xD800)) for _ in range(1500)] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(1500)]
    texts = ["".join(f"x{c}y {c}{c} 1{c}" for c in chars[i : i + 300]) for i in range(0, len(chars), 300)]
    for t, (_, _, _, ids) in zip(texts, codec.texts(texts, True)):
        assert list(ids) == enc.encode_ordinary(t)


def unspaced(kind):
    rng = random.Random(20)
    if kind == "chinese":
        return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1_000_000))
    if kind == "runs of chinese":
        return " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20)) for _ in range(50_000))
    if kind == "thai":
        return "".join(chr(rng.randrange(0x0E01, 0x0E3A)) for _ in range(1_000_000))
    if kind == "base64":
        return base64.b64encode(rng.randbytes(750_000)).decode()
    if kind == "one word":
        return "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    if kind == "long words":
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(200)) for _ in range(5_000))
    return "-" * 20_000 + "ÃÂ" * 3000 + "a" * 3001 + "abc" * 3000 + "=-" * 3001


@pytest.mark.parametrize("kind", ["chinese", "runs of chinese", "thai", "base64", "one word", "long words", "repeats"])
def test_bpe_of_unspaced_texts(codec, kind):
    text = unspaced(kind)
    ((n, _, decoded, ids),) = codec.texts([text], True)
    assert np.array_equal(ids, np.array(encoding("byte_bpe_50k").encode_ordinary(text))) and n == len(ids)
    assert decoded == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_windows_of_any_length(codec, monkeypatch):
    """Cuts at every phase: windows so short that they often have no token in common."""
    monkeypatch.setattr(op1_bpe, "WINDOW", 8)
    monkeypatch.setattr(op1_bpe, "STEP", 4)
    monkeypatch.setattr(op1_bpe, "QUERY_BYTES", 64)
    monkeypatch.setattr(op1_bpe, "QUERY_ROWS", 256)
    rng, enc = random.Random(21), encoding("byte_bpe_50k")
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))).encode() for letters in ("a", "ab", "-=", "etaoin", "日本語", " ", "abcdefghij") for _ in range(12)]
    for p, ids in zip(pieces, codec.encode(pieces)):
        assert ids.tolist() == enc._encode_single_piece(p)
    assert codec.decode(codec.encode(pieces)) == pieces


def test_every_token_is_reached_by_merges(codec):
    """As the library takes a piece that is a token as it is."""
    tokens = list(codec.ranks)
    assert [i.tolist() for i in codec.encode(tokens)] == [[codec.ranks[t]] for t in tokens]


def test_simhash_query(spark, sf):
    docs = load(spark, sf, "documents")

    def fingerprint(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(d["text"]) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = groups(len(docs), links)
    least = defaultdict(list)
    for d, r in zip(docs, root):
        least[r].append(d["doc_id"])
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in query(spark, sf, "op2_simhash")}
    assert out == {d["doc_id"]: (f"{p:016x}", min(least[r])) for d, p, r in zip(docs, prints, root)}


def planted_prints(rng):
    prints = {rng.getrandbits(64) for _ in range(60)}
    for b in list(prints)[:25]:
        for _ in range(4):
            x = b
            for k in rng.sample(range(64), 2):
                x ^= 1 << k
            prints.add(x)
    core = rng.getrandbits(64)
    for _ in range(300):  # a crowd in one bucket
        x = core
        for k in rng.sample(range(11), rng.randrange(6)):
            x ^= 1 << k
        prints.add(x)
    return sorted(prints)


def test_simhash_links_of_crowds(spark):
    prints = planted_prints(random.Random(4))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    brute = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    found = op2_simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    at = {x: i for i, x in enumerate(signed)}
    assert groups(len(prints), [(at[r["a"]], at[r["b"]]) for r in found]) == brute


def test_wide_links(spark, monkeypatch):
    """Groups of edited copies, one of them a crowd: no link beyond the flips, nearly all pairs of 0.85 found."""
    monkeypatch.setattr(op2_simhash, "WIDE_BLOCK", 16)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for g in range(60):
        base = [word() for _ in range(200)]
        for _ in range(70 if g == 0 else 2):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(200)] = word()
            texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    f = np.array([op2_simhash.wide_fingerprint(t.encode()) for t in texts], np.int64).T.copy()
    ids = op2_simhash._node(f[0], f[1]).tolist()
    df = spark.createDataFrame([tuple(r) for r in f.T.tolist()], ", ".join(f"{c} long" for c in op2_simhash._WIDE)).distinct()
    at = {x: i for i, x in enumerate(ids)}
    found = [(at[r["a"]], at[r["b"]]) for r in op2_simhash.wide_links(df).collect()]
    flips = lambda i, j: sum(((int(x[i]) ^ int(x[j])) & (1 << 64) - 1).bit_count() for x in f[:2])
    assert all(flips(i, j) <= op2_simhash.WIDE_FLIPS for i, j in found)
    got = groups(len(texts), found + [(at[x], i) for i, x in enumerate(ids)])
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
    assert sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near)
    assert all(len(sets[i] & sets[j]) > 0.5 * len(sets[i] | sets[j]) for i, j in found)


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    y = x.copy()
    for _ in range(2):
        y ^= (1 << rng.integers(0, 23, 2000)).astype(np.uint32)
    keys = [defaultdict(set), defaultdict(set)]
    for k, w in enumerate((x, y)):
        for r, v in zip(*fuzzy_keys(w, 23)):
            keys[k][r].add(v)
    assert all(keys[0][i] & keys[1][i] for i in range(2000))
    assert max(len(s) for s in keys[0].values()) <= 7


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 420)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(350)] + [(7, 7)]
    root = groups(1000, links)
    df = spark.createDataFrame([(a * 10 - 3000, b * 10 - 3000) for a, b in links], "a long, b long")
    out = {r["node"]: r["root"] for r in components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert out == {x * 10 - 3000: root[x] * 10 - 3000 for x in nodes}
    assert components(df.limit(0)).count() == 0


def test_near_dedup_finds_copies_and_leaves_others(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, near = [], 0
    for i in range(60):
        words = [word() for _ in range(250)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            words[rng.randrange(250)] = word()
            words[rng.randrange(250)] = word()
            rows.append((1000 + i, " ".join(words)))
            near += 1
        if i % 5 == 0:
            rows.append((2000 + i, rows[-1][1]))
    kept = {r["doc_id"] for r in op2_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in kept if i < 1000} == set(range(60)) and not [i for i in kept if i >= 2000]
    assert len([i for i in kept if 1000 <= i < 2000]) <= 0.1 * near


def paired(convs):
    """{chosen: (rejected, borrowed, rejected turns)} of conversations {id: [(role, text)]}."""
    by = defaultdict(list)
    for c in sorted(convs):
        by[convs[c][0]].append(c)
    out, alone = {}, []
    for ids in by.values():
        for k in range(0, len(ids), 2):
            pair = sorted(ids[k : k + 2], key=lambda c: (-len(convs[c]), -sum(len(t) for _, t in convs[c]), c))
            out[pair[0]] = (pair[1], False, convs[pair[1]]) if len(pair) > 1 else (None, False, [])
            alone += [pair[0]] if len(pair) == 1 else []
    last = {c: max((k for k, (r, _) in enumerate(convs[c]) if r == "assistant"), default=None) for c in alone}
    alone = sorted(c for c in alone if last[c] is not None)
    for k, c in enumerate(alone if len(alone) > 1 else []):
        d = alone[(k + 1) % len(alone)]
        out[c] = (d, True, [*convs[c][: last[c]], convs[d][last[d]], *convs[c][last[c] + 1 :]])
    return out


def check_preferences(convs, out):
    expected = paired(convs)
    assert {r["chosen_id"]: (r["rejected_id"], r["borrowed"]) for r in out} == {c: x[:2] for c, x in expected.items()} and len(out) == len(expected)
    render = lambda ts: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in ts)
    for r in out:
        a, b = convs[r["chosen_id"]], expected[r["chosen_id"]][2]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert r["n_shared"] == n and r["prompt"] == render(a[:n])
        for ts, side in ((a, "chosen"), (b, "rejected")):
            text = r[f"{side}_completion"]
            assert text == render(ts[n:])
            spans = [tuple(map(int, s.split("-"))) for s in r[f"{side}_mask"].split(",") if s]
            assert [text[x:y] for x, y in spans] == [f"{t}\n<|end|>\n" for role, t in ts[n:] if role == "assistant"]


def test_preferences_of_the_table(spark, sf):
    turns = load(spark, sf, "conversations")
    convs = defaultdict(list)
    for t in sorted(turns, key=lambda t: (t["conv_id"], t["turn"])):
        convs[t["conv_id"]].append((t["role"], t["text"]))
    out = query(spark, sf, "op3_preferences")
    check_preferences(convs, out)
    whole = [r for r in out if r["rejected_id"] is not None and r["prompt"] and r["chosen_mask"] and r["rejected_mask"] and r["chosen_completion"] != r["rejected_completion"]]
    assert len(whole) > 0.8 * len(out)


def test_preferences_with_nulls_against_sql(spark, tmp_path):
    """Null roles, texts, turns and ids, repeated rows, shared openings and copies: as brute force, and as the SQL."""
    import duckdb

    rng, rows = random.Random(22), []
    for c in range(60):
        opening = rng.choice([("user", "q"), (None, "q"), ("q", None), ("user", None), (None, None), ("system", f"s{c}"), ("user", f"u{c}")])
        rows.append((c - 20, 0, *opening))
        for t in range(1, rng.randrange(1, 6)):
            rows.append((c - 20, rng.choice([t, t, None]), rng.choice(["user", "assistant", "assistant", None]), rng.choice([f"x{c}{t}", "same", "", None])))
    rows += rows[::5] + [(None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = [r.asDict() for r in op3_preferences.op3_preferences(spark, str(tmp_path)).collect()]
    convs = defaultdict(list)
    for c, _, role, text in sorted({(c, (t is None, t or 0), r or "user", x or "") for c, t, r, x in rows if c is not None}):
        convs[c].append((role, text))
    check_preferences(convs, out)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(op3_preferences.ORACLE["op3_preferences"])
    assert sorted(map(str, (dict(zip(rel.columns, r)) for r in rel.fetchall()))) == sorted(map(str, out))


def test_pairs_in_a_crowd(spark):
    rows = [(i * 37 % 3001, t, r, f"{r}{t}" if t == 0 else f"{i}") for i in range(900) for t, r in ((0, "user"), (1, "assistant"))]
    out = pair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    ids = sorted({r[0] for r in rows})
    assert {frozenset((r["chosen_id"], r["rejected_id"])) for r in out} == {frozenset(ids[k : k + 2]) for k in range(0, 900, 2)} and not any(r["borrowed"] for r in out)


def planted_passages(rng, n=120):
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9)))

    def prose(k):
        out = []
        while len(out) < k:
            s = [word() for _ in range(rng.randrange(4, 16))]
            out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
        return out

    shared = [prose(70) for _ in range(4)]
    rows, holds = [], {}
    for i in range(n):
        host = prose(rng.randrange(60, 300))
        if i % 4 == 0:
            k, at = rng.randrange(4), rng.randrange(len(host))
            holds[i] = k
            host = host[:at] + shared[k] + host[at:]
        lines = [" ".join(host[j : j + 40]) for j in range(0, len(host), 40)] if i % 8 == 1 else [" ".join(host)]
        rows.append((i, "\n".join(lines)))
    return rows, holds


def test_passages_are_cut_but_once(spark):
    rows, holds = planted_passages(random.Random(8))
    out = {r["doc_id"]: r for r in op4_passages.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, k in sorted(holds.items()):
        first.setdefault(k, i)
    cut = {i for i, r in out.items() if r["mr_removed"]}
    later = {i for i, k in holds.items() if first[k] != i}
    assert not cut - later  # clean documents and first holders are left alone
    assert len(cut & later) >= 0.9 * len(later)
    for i, text in rows:
        if i not in cut:
            assert out[i]["text"] == text


def test_paragraph_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    rows, _ = planted_passages(rng, 60)
    # A near copy of each tenth document: one word in twenty-five another.
    for i, t in rows[::10]:
        w = t.split(" ")
        for k in range(12, len(w), 25):
            w[k] = "changed"
        rows.append((500 + i, " ".join(w)))
    names, words = {}, {}
    for i, t in rows:
        for _, _, w in op4_passages.paragraphs(t.encode()):
            if len(w) >= op4_passages.UNIT_WORDS:
                words[op4_passages._name(w)] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                names.setdefault(op4_passages._name(w), set()).add(i)
    keys = list(words)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b])]
    bands = {k: set(op4_passages._bands([list(x)])[0].tolist()) for k, x in ((op4_passages._name(w), w) for _, t in rows for _, _, w in op4_passages.paragraphs(t.encode()) if len(w) >= op4_passages.UNIT_WORDS)}
    met = sum(bool(bands[a] & bands[b]) for a, b in pairs)
    assert not pairs or met >= 0.9 * len(pairs)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((700, 32))
    for c in range(40):  # neighbours at all distances from the threshold
        x[600 + c] = x[c] / np.linalg.norm(x[c]) + rng.standard_normal(32) * rng.uniform(0.01, 0.12)
    x[640:] = x[600] / np.linalg.norm(x[600]) + rng.standard_normal((60, 32)) * 0.02  # a crowd
    x[650] = x[649]
    labels = rng.integers(0, 3, 700)
    labels[600:640], labels[640:] = labels[:40], labels[600]
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(700, dtype=bool)
    out = {r["vec_id"]: r for r in op5_vectors.vector_groups(df).collect()}
    found = sum(out[i]["n_links"] for i in range(700))
    assert all(out[i]["n_links"] <= near[i].sum() for i in range(700)) and found >= 0.97 * near.sum()
    root = groups(700, list(zip(*np.nonzero(near))))
    assert np.mean([out[i]["component_id"] == root[i] for i in range(700)]) > 0.99


def test_vectors_near_the_threshold(spark):
    """Thousands of vectors, planted pairs around the threshold, and a crowd: nothing under it is linked, and of what reaches it
    nearly all is, also just above it."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(1500):
        away = rng.standard_normal(64)
        away -= (away @ x[k]) * x[k]
        c = rng.uniform(0.915, 0.955)
        x[3000 + k] = c * x[k] + np.sqrt(1 - c * c) * away / np.linalg.norm(away)
    x[5600:] = x[5600] + rng.standard_normal((400, 64)) * 0.03
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = rng.integers(0, 10, 6000)
    labels[3000:4500], labels[5600:] = labels[:1500], 3
    s = x @ x.T
    near = (s >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(6000, dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    found = np.array([r[1] for r in sorted((r["vec_id"], r["n_links"]) for r in op5_vectors.vector_groups(df).collect())])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.99 * near.sum()
    just = [k for k in range(1500) if 0.93 <= s[k, 3000 + k] < 0.935]
    assert len(just) > 100 and np.mean(found[just] > 0) >= 0.97


def test_vectors_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(op5_vectors, "BLOCK", 16)
    rng = np.random.default_rng(12)
    x = np.concatenate([np.ones(16) + rng.standard_normal((150, 16)) * 0.03, rng.standard_normal((20, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in op5_vectors.vector_groups(df).collect()} == dict(enumerate(near.tolist()))


def test_quality_counts_and_verdicts(spark, sf):
    docs = {d["doc_id"]: d for d in load(spark, sf, "documents")}
    out = query(spark, sf, "op6_quality")
    assert len(out) == len(docs)
    for r in out:
        text = docs[r["doc_id"]]["text"]
        words = text.encode().split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>") and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    # Labels: of the documents that pass the base rules, the bad ones go and the good ones stay.
    quality = {x["doc_id"]: x["quality"] for x in load(spark, sf, "labels")}
    rest = [(quality[r["doc_id"]], r["kept"]) for r in out if r["doc_id"] in quality and not r["base_failed"]]
    assert all(kept for q, kept in rest if q) and not any(kept for q, kept in rest if not q)


def test_sketches_merge(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = op6_quality.with_counts(docs)
    whole = {tuple(r) for r in op6_quality.sketch(counts).collect()}
    parts = op6_quality.sketch(counts.where("doc_id % 2 = 0")).union(op6_quality.sketch(counts.where("doc_id % 2 = 1")))
    merged = {tuple(r) for r in parts.groupBy("lang", "source", "rule", "bucket").sum("n").collect()}
    assert whole == merged
    # Quantiles are within the relative error of the exact ones.
    by = defaultdict(list)
    for r in counts.where(f"NOT ({op6_quality.BASE_FAILED})").selectExpr("lang", "(word_chars + 1) / (n_words + 1) AS v").collect():
        by[r["lang"]].append(r["v"])
    for r in op6_quality._quantiles(op6_quality.sketch(counts), "lang").collect():
        exact = sorted(by[r["lang"]])[math.ceil(len(by[r["lang"]]) * 0.5) - 1]
        assert exact <= math.exp(op6_quality.LOG_GAMMA * r["word_length_mid"]) <= exact * (1 + 2.1 * op6_quality.SKETCH_ERROR)


def group(source, n, seed, length, symbols, chars, lines):
    """Counts of n documents of a source."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = round(length * math.exp(rng.gauss(0, 0.5))) + 50
        rows.append((f"{source}{i}", "en", source, words, round(words * chars * math.exp(rng.gauss(0, 0.03))), round(words * symbols * rng.random()), round(lines * rng.random()), 0, round(lines * (1 + rng.random())) + 1))
    return rows


def test_limits_are_the_groups_own(spark):
    """Every rule's limits differ between groups with different quantiles, and move with their size without a jump."""
    kind = "doc_id string, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    rows = group("a", 2000, 1, 300, 0, 5, 4) + group("b", 2000, 2, 300, 0.3, 8, 40)
    limits = {r["mr_source"]: r.asDict() for r in op6_quality.thresholds(op6_quality.sketch(spark.createDataFrame(rows, kind))).collect()}
    for column in ("mr_symbols_max", "mr_dup_lines_max", "mr_word_length_max", "mr_word_length_min"):
        assert abs(math.log(limits["a"][column] / limits["b"][column])) > 0.2, column
    # The same documents are fine where they are usual, and not where they aren't.
    symbols = spark.createDataFrame([(f"x{s}", "en", s, 300, 300 * chars, 80, 0, 0, 10) for s, chars in (("a", 5), ("b", 8))], kind)
    judged = op6_quality._judge(symbols, op6_quality.thresholds(op6_quality.sketch(spark.createDataFrame(rows, kind)))).collect()
    assert {r["doc_id"]: r["kept"] for r in judged} == {"xa": False, "xb": True}
    at = []
    for n in (0, 50, 99, 100, 101, 400, 3000):
        few = group("a", 2000, 1, 300, 0, 5, 4) + group("c", n, 3, 300, 0.3, 8, 40)
        found = {r["mr_source"]: r["mr_word_length_max"] for r in op6_quality.thresholds(op6_quality.sketch(spark.createDataFrame(few, kind))).collect()}
        at.append(found.get("c", found["a"]))
    assert abs(math.log(at[3] / at[2])) < 0.01 and abs(math.log(at[4] / at[3])) < 0.01 and at[1] < at[3] < at[5] < at[6]


def test_shards_are_even(spark, sf):
    out = query(spark, sf, "op7_sharding")
    total, at = sum(r["size"] for r in out), Counter()
    for r in out:
        at[r["shard"]] += r["size"]
    most = max(r["size"] for r in out)
    assert all(abs(at[s] - total / 40) <= most for s in range(40))


def test_rendering():
    page = """<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>
    three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>
    <table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>
    <div style="display: none">no</div><span hidden>no</span>end<pre>  a
   b</pre>&copy; x<!-- c --><script>var t="</p>";</script> z<img alt="pic"></body></html>"""
    assert html_to_text(page) == "\n".join([
        "Head", "", "One two three", "", "Four", "five", "", "- a", "- b", "  3. x", "  4. y", "- c", "", "Name       N", "long name  1", "b          22", "",
        "end", "", "  a", "   b", "", "© x zpic",
    ])
    assert html_to_text("<p>a</div>b</p>c") == "a b\n\nc" or html_to_text("<p>a</div>b</p>c") == "ab\n\nc"
    # The option that a select shows is text of the page.
    assert html_to_text("<select><option>x</select>a<textarea> t </textarea>") == "x a t"
    assert html_to_text("1 < 2 && 3 > 2") == "1 < 2 && 3 > 2"


def test_pages_keep_all_their_words(spark, sf):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = Counter(), 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.words.update(data.split())

    pages = {p["page_id"]: p["html"] for p in load(spark, sf, "pages")}
    for r in query(spark, sf, "op8_html"):
        parser = Words()
        parser.feed(pages[r["page_id"]])
        got = Counter(r["text"].split())
        del got["-"], parser.words["-"]
        assert got == parser.words


def test_token_totals(spark, sf):
    expected, seen = Counter(), set()
    for d in sorted(load(spark, sf, "documents"), key=lambda d: d["doc_id"]):
        if d["text"] in seen:
            continue
        seen.add(d["text"])
        for v in ("byte_bpe_50k", "byte_bpe_multi_50k"):
            expected[(d["source"], d["lang"], v, "docs")] += 1
            expected[(d["source"], d["lang"], v, "tokens")] += len(ENC.setdefault(v, encoding(v)).encode_ordinary(d["text"]))
    got = {}
    for r in query(spark, sf, "op9_counts"):
        got[(r["source"], r["lang"], r["version"], "docs")] = r["n_docs"]
        got[(r["source"], r["lang"], r["version"], "tokens")] = r["n_tokens"]
    assert got == dict(expected)


ENC: dict = {}


def test_poisson(spark):
    rates = [0.01, 0.3, 1.0, 4.5, 40.0, 900.0]
    rows = [(r, u) for r in rates for u in (0.0, 1e-9, 0.1, 0.5, 0.9, 0.999, 1 - 2**-50)]
    from pyspark.sql import functions as F

    out = op10_mixing.with_tables(spark.createDataFrame(rows, "rate double, u double")).select("rate", "u", op10_mixing.poisson_count(F.col("u")).alias("k")).collect()
    assert len(out) == len(rows)
    decimal.getcontext().prec = 60
    for r in out:
        # With 60 digits; chances that no double holds count as none.
        rate, k = decimal.Decimal(r["rate"]), 0
        cdf = p = (-rate).exp()
        while cdf <= decimal.Decimal(r["u"]) or float(cdf) == 0:
            k += 1
            p *= rate / k
            cdf += p
        assert abs(r["k"] - k) <= (1 if r["u"] > 1 - 1e-9 else 0), r


def test_poisson_of_high_rates():
    """Mean and deviation, and no more values than a few deviations need."""
    for rate in (1e4, 1e6, 1e9):
        least, cdf = op10_mixing.poisson_table(rate)
        pmf, k = np.diff(cdf, prepend=0), least + np.arange(len(cdf)) - rate
        assert abs((pmf * k).sum()) < 0.01 * rate**0.5 and abs((pmf * k * k).sum() / rate - 1) < 0.01 and len(cdf) < 53 * rate**0.5 + 100


def test_mixture_of_a_small_source(spark):
    """A source of few bytes is repeated thousands of times, each document as often as its table says."""
    rows = [(i, "x" * 100, "big") for i in range(20_000)] + [(30_000 + i, "y" * 50, "small") for i in range(4)]
    out = op10_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = out.where("source = 'small'").groupBy("doc_id").agg({"copy_no": "max", "*": "count", "n_copies": "max", "text": "max"}).collect()
    assert len(got) == 4 and all(r["count(1)"] == r["max(n_copies)"] == r["max(copy_no)"] + 1 and abs(r["max(n_copies)"] / 5000 - 1) < 0.1 and r["max(text)"] == "y" * 50 for r in got)
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_mixture_meets_its_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 10 else "small") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r["source"] for r in op10_mixing.mix(df, {"big": 1, "small": 3}).select("source").collect())
    assert abs(got["small"] / 15_000 - 1) < 0.05 and abs(got["big"] / 5_000 - 1) < 0.06


def test_pipeline(spark):
    """Each stage against what the one before it kept, and the whole against the stages."""
    sf = "/root/testdata/sf0.001"
    docs = load(spark, sf, "documents")
    q = {d["doc_id"] for d in docs} & {r["doc_id"] for r in query(spark, sf, "op6_quality") if r["kept"]}
    frames, df = {}, spark.read.parquet(f"{sf}/documents.parquet")
    from millrace.llm.common import stage

    for name, f in corpus_pipeline.STAGES:
        df = stage(f(spark, df, sf), f"test-{name}")
        frames[name] = [r.asDict() for r in df.collect()]
        if name != "tokens":
            assert df.columns == list(corpus_pipeline.COLUMNS)
    by = {d["doc_id"]: d for d in docs}
    assert {d["doc_id"] for d in frames["quality"]} == q and all(d == by[d["doc_id"]] for d in frames["quality"])
    # Near-duplicates: one of each group of equal texts, and clean documents stay.
    near = {d["doc_id"]: d["text"] for d in frames["near_duplicates"]}
    assert len(set(near.values())) == len(near) and set(near) <= q
    prints = {d["doc_id"]: [x & (1 << 64) - 1 for x in op2_simhash.wide_fingerprint(d["text"].encode())[:2]] for d in frames["quality"]}
    ids = sorted(prints)
    flips = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(prints[ids[i]], prints[ids[j]]))
    links = lambda most: [(i, j) for i in range(len(ids)) for j in range(i) if flips(i, j) <= most]
    surely, possibly = (groups(len(ids), links(k)) for k in (0, op2_simhash.WIDE_FLIPS))
    assert {ids[r] for r in possibly} <= set(near) <= {ids[r] for r in surely}
    cut = {d["doc_id"]: d for d in frames["passages"]}
    assert set(cut) <= set(near)
    for i, d in cut.items():
        words = iter(near[i].split())
        assert all(w in words for w in d["text"].split()) and d["n_chars"] == len(d["text"])
    copies = Counter(d["doc_id"] for d in frames["mixing"])
    assert set(copies) <= set(cut) and all(d == cut[d["doc_id"]] for d in frames["mixing"])
    enc = encoding("byte_bpe_50k")
    assert len(frames["tokens"]) == len(frames["mixing"])
    for d in frames["tokens"]:
        assert d["ids"] == enc.encode_ordinary(cut[d["doc_id"]]["text"]) and d["n_tokens"] == len(d["ids"])
    whole = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, frames["tokens"]))


@pytest.mark.parametrize("name", ["op7_sharding", "op10_mixing"])
def test_repeatable(spark, sf, name):
    a, b = (sorted(str(sorted(r.items())) for r in query(spark, sf, name)) for _ in range(2))
    assert a == b
