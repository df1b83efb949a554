"""Places where an operator once did less than the whole job."""

import random
import time

import pytest

from millrace.llm import op2_simhash, op4_passages
from millrace.llm.op4_passages import drop_repeats
from millrace.llm.op8_html import html_to_text


def edited(rng, n, similarity):
    """Two texts of n words whose sets of five-word shingles have about this Jaccard similarity; and the set's own."""
    words = [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    other = list(words)
    for i in rng.sample(range(0, n - 6, 6), round(n * (1 - similarity) / (1 + similarity) / 5)):
        other[i + 3] = f"x{rng.getrandbits(40):x}"
    a, b = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (words, other))
    return " ".join(words), " ".join(other), len(a & b) / len(a | b)


def test_near_dedup_goes_by_jaccard(spark):
    """Recall at 0.8 and more, precision from 0.7 to 0.8; chains of less similar texts aren't joined."""
    rng = random.Random(12)
    rows, near, far = [], [], []
    for i in range(320):
        a, b, similarity = edited(rng, 400, (0.7, 0.74, 0.78, 0.81, 0.85)[i % 5])
        (near if similarity >= 0.8 else far).append(1000 + i)
        rows += [(i, a), (1000 + i, b)]
    kept = {r["doc_id"] for r in op2_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(320)) <= kept and set(far) <= kept
    assert len(near) > 100 and len(kept & set(near)) <= 0.03 * len(near)


def test_near_dedup_of_a_template(spark, monkeypatch):
    """Documents that share half their words are left alone, and copies among them go, in blocks as well."""
    monkeypatch.setattr(op2_simhash, "WIDE_BLOCK", 16)
    rng = random.Random(13)
    shared = [f"s{k}" for k in range(240)]
    texts = [" ".join(shared + [f"w{rng.getrandbits(40):x}" for _ in range(70)]) for _ in range(60)]
    rows = [*enumerate(texts), *((100 + i, texts[i] + " more") for i in range(0, 60, 6))]
    kept = {r["doc_id"] for r in op2_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(60))


def shared_words(rng, n, kind):
    """n random words: lines of four to seven words, no sentence ends at all, or prose."""
    out = []
    while len(out) < n:
        s = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(4, 8) if kind == "verse" else rng.randrange(8, 21))]
        out += s if kind == "bare" else [*s[:-1], s[-1] + ("\n" if kind == "verse" else ".")]
    return out[:n]


def joined(words):
    return " ".join(words).replace("\n ", "\n")


@pytest.mark.parametrize("kind", ["verse", "bare", "prose"])
def test_passages_of_any_form(spark, kind):
    """51 to 200 words that an earlier document has too go, wherever they were put; 30 stay."""
    rng = random.Random(14)
    rows, later, short = [], {}, []
    for i in range(80):
        n = (30, 51, 60, 100, 200)[i % 5]
        shared = shared_words(rng, n, kind)
        for d in (i, 1000 + i):
            host = shared_words(rng, rng.randrange(80, 200), kind)
            at = rng.randrange(len(host))
            # Words of their own beside the passage.
            rows.append((d, joined([*host[:at], f"left{d}", *shared, f"right{d}", *host[at:]])))
        short.append(1000 + i) if n < 50 else later.update({1000 + i: n})
    out = {r["doc_id"]: r["mr_removed"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A paragraph that is nearly equal goes with the words of its own.
    assert all(n <= out[d] <= n + 12 for d, n in later.items()), [(out[d], n) for d, n in later.items() if out[d] != n]
    assert not any(out[d] for d in [*short, *range(80)])


def test_passages_with_a_frequent_sentence(spark):
    """A passage that documents 1000 + i and 2000 + i share is cut though document i, which is the first to have one of its sentences, has no more of it."""
    rng = random.Random(15)
    rows, n = [], 60
    for i in range(n):
        sentences = [shared_words(rng, 12, "prose") for _ in range(5)]
        for s in sentences:
            s[-1] = s[-1].rstrip(".") + "."
        shared = [w for s in sentences for w in s][:51]
        rows.append((i, joined(shared_words(rng, 100, "prose") + ["End."] + sentences[1] + shared_words(rng, 100, "prose"))))
        for d in (1000 + i, 2000 + i):
            rows.append((d, joined(shared_words(rng, 93, "prose") + [f"left{d}"] + shared + [f"right{d}"] + shared_words(rng, 93, "prose"))))
    out = {r["doc_id"]: r["mr_removed"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2000 + i] >= 51 for i in range(n)) and not any(out[i] or out[1000 + i] for i in range(n))


def test_frequent_sentences_in_a_row_stay(spark):
    """Five sentences in a row, each first seen in another document, are no passage."""
    rng = random.Random(16)
    rows, n = [], 40
    for i in range(n):
        sentences = [[*shared_words(rng, 10, "bare"), f"end{i}{k}."] for k in range(5)]
        for k, s in enumerate(sentences):
            rows.append((10 * i + k, joined(shared_words(rng, 60, "prose") + ["End."] + s + shared_words(rng, 60, "prose"))))
        rows.append((10_000 + i, joined(["Start."] + [w for s in sentences for w in s] + shared_words(rng, 60, "prose"))))
    out = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("mr_removed > 0")
    assert out.count() == 0


def test_changed_paragraphs_still_go(spark):
    """A passage with a word changed in every 40 has no 50 words in a row, but its paragraphs are nearly equal."""
    rng = random.Random(17)
    rows = []
    for i in range(40):
        shared = [w for _ in range(5) for w in [*shared_words(rng, 39, "bare"), f"end{rng.getrandbits(20)}."]]
        other = list(shared)
        for k in range(2, 200, 40):
            other[k] = "changed"
        for d, s in ((i, shared), (1000 + i, other)):
            rows.append((d, joined(shared_words(rng, 60, "prose") + ["End."] + s + shared_words(rng, 60, "prose"))))
    out = {r["doc_id"]: r["mr_removed"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[1000 + i] >= 100 for i in range(40)) >= 36 and not any(out[i] for i in range(40))


@pytest.mark.parametrize("decoys", ["none", "one side", "both sides", "many"])
def test_changed_passages_meet_every_earlier_holder(spark, decoys):
    """Nearly equal paragraphs of 40 words with equal words beside them go if any earlier document has enough of these, whoever
    has the paragraphs and some of the words before it."""
    rng = random.Random(18)
    rows, n = [], 40
    for i in range(n):
        own = [*shared_words(rng, 39, "bare"), f"end{rng.getrandbits(20)}."]
        left, right = ["Ahead", *shared_words(rng, 6, "bare"), "stop."], shared_words(rng, 14, "bare")
        # (id, words of the left side, words of the right side) that a document shares with the later one
        holders = [(1000 + i, 0, 14)] if decoys in ("none", "one side") else [(1000 + i, 6, 6)]
        holders += {"none": [], "one side": [(i, 0, 4)], "both sides": [(i, 8, 1), (500 + i, 1, 8)], "many": [(i + 40 * k, 2 + k % 3, 2 + k % 4) for k in range(10)]}[decoys]
        for d, a, b in [(5000 + i, 8, 14), *holders]:
            p = list(own)
            if d != 5000 + i:
                p[1] = f"changed{d if d < 1000 else ''}"
            # The sentence before has words of its own enough, so that the paragraph begins at the same word.
            before = [*shared_words(rng, 60, "prose"), "End.", *shared_words(rng, 8, "bare"), *(left[8 - a :] or [f"stop{d}."])]
            rows.append((d, joined([*before, *p, *right[:b], f"own{d}", *shared_words(rng, 60, "prose")])))
    out = {r["doc_id"]: r["mr_removed"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[5000 + i] >= 50 for i in range(n)) >= 38 and not any(x for d, x in out.items() if d < 5000), sorted(out.items())[-n:]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
        ("<p>a <svg><title>no</title><text x=1>seen</text></svg> b", "a seen b"),
        ("<p>a <select><option>one<option selected>two</select> b", "a two b"),
        ("<p>a <select><option disabled>none<optgroup><option>one</optgroup></select> b", "a one b"),
        ("<p>a <select multiple><option>one<option>two</select> b", "a one two b"),
        ("a<xmp><b>&amp;</b></xmp>b", "a\n\n<b>&amp;</b>\n\nb"),
        ("a<plaintext><b>b</plaintext>", "a\n\n<b>b</plaintext>"),
        ("a<dialog open>b</dialog>c", "a\nb\nc"),
        ("a<dialog>b</dialog>c", "ac"),
        ('<table><tr><td colspan="²">a<td>b</table>', "a  b"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=9 type=A><li>a<li>b</ol>", "I. a\nH. b"),
        ("<ol type=i start=3><li>a<li>b<li type=a value=28>c</ol>", "iii. a\niv. b\nab. c"),
        ("<ol type=I start=0><li>a<li>b</ol>", "0. a\nI. b"),
        ("a<object>in its place</object><object data=x>no</object>", "ain its place"),
        ('<ol start="--5"><li>a</ol>', "1. a"),
        ('<ol start=" 7x"><li>a<li value=9>b<li>c</ol>', "7. a\n9. b\n10. c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\n   d  e"),
        ("<table><tr><td colspan=2>a long cell over two<td>z<tr><td>1<td>2<td>3</table>", "a long cell over two  z\n1  2                  3"),
        ("<table><tr><td colspan=100000>a<td>z<tr><td>1<td>2</table>", "a     z\n1  2"),
        ("<table><tr><td>a<td rowspan=2>two<br>lines<td>c<tr><td>d<td>e</table>", "a  two    c\n   lines\nd         e"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>x", "yes\n\nx"),
        ("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>a<tr><td>b<td>c</table>", "   a\nb  c"),
        ("<p style='display:none'>no <b style='display:block'>no</b></p><p style='x-display:none'>x", "x"),
        ("<map>in map<area></map>", "in map"),
        ("<head>text", "text"),
        ("<head><title>no</title><body>text", "text"),
        ("<textarea><b>x</textarea>y", "<b>xy"),
        ("<input value=v><input type=password value=no>", "v"),
        ('<a title="x>y">z</a>', "z"),
        ("a<!-->b<!--no--!>c<!-- no > -->d<!no>e<?no>f</ no>g</>h", "abcdefgh"),
        ("1 < 2 <3 a<", "1 < 2 <3 a<"),
        ("a <b", "a"),
    ],
)
def test_pages_with_rarer_elements(html, text):
    assert html_to_text(html) == text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, '<div "' * 170_000, '<a b="' * 170_000, "<" * 1_000_000, "</b" * 300_000, "</b>" * 250_000, "<p>" * 300_000, "<!--" * 250_000, "&" * 1_000_000,
        "<script>" * 120_000, "<a " + " " * 1_000_000, "<a" + " a= " * 250_000, "<a style='" + "display : " * 100_000, "<div>" * 200_000, "<ul><li>" * 120_000, "<h1>" * 250_000,
    ],
    ids=lambda p: p[:8].strip(),
)
def test_pages_of_a_megabyte_take_a_moment(page):
    start = time.process_time()
    html_to_text(page + "x")
    assert time.process_time() - start < 5  # most take a tenth of a second


def test_tables_that_are_nearly_all_blanks():
    """Every word stays, though nothing is aligned."""
    text = html_to_text("<table>" + "".join(f"<tr><td rowspan=60000>x{i}" for i in range(3000)))
    assert text.split() == [f"x{i}" for i in range(3000)] and len(text) < 100_000


def cells_apart(rows):
    """A renderer of its own: the lines of a table of plain cells (text, columns, rows), drawn on a grid."""
    grid, spans, y = {}, [], 0
    for row in rows:
        x = 0
        for text, wide, high in row:
            while (y, x) in grid:
                x += 1
            grid |= {(y + j, x + i): None for j in range(high) for i in range(wide)}
            grid[y, x] = text
            spans.append((x, wide, text))
            x += wide
        y += 1
    n = max(x for _, x in grid) + 1
    width = [0] * n
    for x, wide, text in sorted(spans, key=lambda s: s[1]):
        used = [w for w in width[x : x + wide] if w]
        # Columns in which nothing begins are none.
        last = max(c for c in range(x, x + wide) if c == x or any(s[0] == c for s in spans))
        have = sum(used) + 2 * max(0, len(used) - 1)
        if have < len(text):
            width[last] += max(1, len(text) - have - 2) if used and not width[last] else len(text) - have
    at = [sum(w + 2 for w in width[:x] if w) for x in range(n)]
    out = []
    for j in range(y):
        line = ""
        for x in range(n):
            if grid.get((j, x)):
                line = line.ljust(at[x]) + grid[j, x]
        if line:
            out.append(line)
    return "\n".join(out)


def test_tables_against_a_grid():
    rng = random.Random(18)
    for _ in range(300):
        rows = [[("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]
        # A row's cells are at its end free places; rows whose cells would overlap those from above differ by design.
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in r) for r in rows)
        if overlaps(rows):
            continue
        assert html_to_text(html) == cells_apart(rows), html


def overlaps(rows):
    taken = set()
    for y, row in enumerate(rows):
        x = 0
        for _, wide, high in row:
            while (y, x) in taken:
                x += 1
            cells = {(y + j, x + i) for j in range(high) for i in range(wide)}
            if cells & taken:
                return True
            taken |= cells
            x += wide
    return False


def test_deep_lists_and_sparse_tables_are_bounded():
    page = "<ul><li>x" * 110_000
    text = html_to_text(page)
    assert len(text) < 4 * len(page) and text.count("x") == 110_000 and text.startswith("- x\n  - x\n    - x")
    # One rule at every size: mostly blanks isn't aligned.
    for n in (40, 4000):
        sparse = f"<table><tr><td>{'wide ' * n}<td>a" + "<tr><td><td>b" * 40 + "</table>"
        assert len(html_to_text(sparse)) < 3 * len(sparse)
    assert html_to_text("<table><tr><td>name<td>n<tr><td>x<td>1</table>") == "name  n\nx     1"


def repeated_words(rows, n=50):
    """{document: numbers of its words that lie in n words in a row which an earlier document has too}, by brute force."""
    first, out = {}, {}
    texts = {i: (t or "").encode().lower().split() for i, t in rows}
    for i in sorted(texts):
        w = texts[i]
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out[i] = gone
    return out


def covered(runs):
    return {k for r in runs or [] for k in range(r["first"], r["last"])}


def with_changed_paragraphs(rows):
    """Documents with a paragraph that is nearly equal, but not equal, to one of another document or their own."""
    grams, holders, where = {}, {}, {}
    for i, t in rows:
        for _, _, w in op4_passages.paragraphs((t or "").encode()):
            if len(w) >= op4_passages.UNIT_WORDS:
                grams[tuple(w)] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                holders.setdefault(tuple(w), set()).add(i)
    for u, g in grams.items():
        for x in g:
            where.setdefault(x, []).append(u)
    out = set()
    for u, g in grams.items():
        for v in {v for x in g for v in where[x]} - {u}:
            if len(g & grams[v]) >= 0.8 * len(g | grams[v]):
                out |= holders[u] | holders[v]
    return out


def test_repeats_against_brute_force(spark):
    """Shared stretches of 20 to 300 words in every mixture, copies and self-repeats: what goes is exactly that."""
    rng = random.Random(19)
    pool = [shared_words(rng, rng.randrange(20, 300), "bare") for _ in range(30)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            w += shared_words(rng, rng.randrange(0, 60), "bare") + (part if rng.random() < 0.5 else part[a : a + rng.randrange(1, 120)])
        rows.append((i, joined(w)))
        if i % 10 == 0:
            rows.append((1000 + i, joined(w)))
        if i % 25 == 0:
            rows += [(2000 + i + k, joined([*w[: len(w) // 2], f"edit{k}", *w[len(w) // 2 :]])) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {r["d"]: r["doc_id"] for r in op4_passages._keyed(df).selectExpr("mr_doc AS d", "doc_id").collect()}
    got = {ids[r["mr_doc"]]: covered(r["runs"]) for r in op4_passages.repeats(df).collect()}
    expected = {i: x for i, x in repeated_words(rows).items() if x}
    # Nearly equal paragraphs may take more with them, in documents that have some; never less goes.
    assert all(x <= got.get(i, set()) for i, x in expected.items())
    more = {i for i, x in got.items() if x - expected.get(i, set())}
    assert more <= with_changed_paragraphs(rows) and len(more) < 0.2 * len(rows)


def test_passages_of_the_table_against_brute_force(spark, sf):
    """The query: all of 50 words in a row that an earlier document has, and its holder; more only beside changed paragraphs."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = repeated_words(rows)
    out = {r["doc_id"]: r for r in op4_passages.op4_passages(spark, sf).collect()}
    assert set(out) == {i for i, _ in rows}
    assert all(out[i]["n_removed_words"] >= len(x) for i, x in expected.items())
    more = {i for i, x in expected.items() if out[i]["n_removed_words"] > len(x)}
    assert more <= with_changed_paragraphs(rows) and len(more) < 0.05 * len(rows)
    assert all(d < i for i, r in out.items() for d in r["kept_in"])
