"""Periodic runs, HTML extraction and vector codes against brute force, on small tables and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import codes, common, dom, htmltext, runs
from tests.conftest import SMALL, same_rows
from tests.llm.test_operators import DOCS, ODD, SPACE

# 11 periodic runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every run by comparing words of every period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        at = 0
        for same, some in itertools.groupby(x == y for x, y in zip(w, w[q:])):
            n = len(list(some))
            if same and n >= q and n + q >= 12:
                part = w[at : at + n + q]
                if not any(part[: n + q - r] == part[r:] for r in range(1, q)):
                    out.append((at, n + q, q))
            at += n
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_op11(doc_id, text):
    w = SPACE.findall(text or "")
    n = len(w)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_small_words():
    """Random and periodic texts, several at once, under all of the arrays."""
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 60))]
            texts.append(w[:20] + w[20 : 20 + rng.randint(1, 10)] * rng.randint(0, 8) + w[:5])
        found = runs.found_in(texts)
        for k, w in enumerate(texts):
            assert [tuple(r) for r in found.get(k, np.empty((0, 3), int)).tolist()] == plain_runs(w)


def test_runs_in_packs(monkeypatch):
    monkeypatch.setattr(runs, "PACK", 30)
    texts = [[b"a", b"b"] * 9, [b"c"] * 40, [], [b"x"] * 11, [b"d", b"e", b"f"] * 4]
    assert {k: r.tolist() for k, r in runs.found_in(texts).items()} == {0: [[0, 18, 2]], 1: [[0, 40, 1]], 4: [[0, 12, 3]]}


def test_run_of_a_long_text():
    """A Fibonacci text has many runs, a text of one word a single one; both are worked on as a whole."""
    a, b = [b"a"], [b"b"]
    for _ in range(15):
        a, b = b, b + a
    assert [tuple(r) for r in runs.found_in([b])[0].tolist()] == plain_runs(b)
    assert runs.found_in([[b"w"] * 200_000])[0].tolist() == [[0, 200_000, 1]]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_op11(spark, tmp_path, which):
    extra = [(k, " ".join(f"w{j % (k + 2)}" for j in range(60)), "en", "a", 0) for k in range(20, 60)]
    docs = common.documents(spark, SMALL) if which == "small" else spark.createDataFrame([*ODD, *extra, *extra[:3]], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 40_000]
    ids = {r.doc_id for r in rows}
    got = sorted((tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect() if r.doc_id in ids), key=str)
    assert got == sorted((plain_op11(*r) for r in rows), key=str)


# 12 HTML extraction


def tree(rng: random.Random, n: int) -> dom.Page:
    page = dom.Page()
    for k in range(1, n):
        up = rng.randrange(k)
        page.parents.append(up)
        page.depths.append(page.depths[up] + 1)
        page.tags.append(rng.choice(["div", "p", "nav"]))
        page.roles.append([])
        page.labels.append(0)
        page.own.append(0)
        page.links.append(0)
    return page


def test_marginals_equal_sums_over_all_labellings():
    rng, gen = random.Random(3), np.random.default_rng(3)
    pages = [tree(rng, n) for n in (1, 2, 5, 9)]
    forest = htmltext.Forest.of(pages)
    unary, pair = gen.normal(size=(len(forest.parent), 2)) * 2, gen.normal(size=(2 * len(dom.EDGES), 2, 2)) * 2
    got, joint = htmltext.marginals(forest, unary, pair)
    at = 0
    for page in pages:
        n = len(page.parents)
        total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            s = sum(unary[at + k, y[k]] for k in range(n)) + sum(pair[forest.edge[at + k], y[page.parents[k]], y[k]] for k in range(1, n))
            total += np.exp(s)
            one += np.exp(s) * np.array(y)
            for k in range(1, n):
                both[k, y[page.parents[k]], y[k]] += np.exp(s)
        assert np.allclose(got[at : at + n], one / total) and np.allclose(joint[at + 1 : at + n], both[1:] / total)
        at += n


def article(html: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_main_text(spark):
    """The articles of all pages, also where their telling elements are plain ones and none of them is labelled."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    got = {r.page_id: r for r in htmltext.op12_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows) and all(r.text == article(rows[k].html) and r.n_chars == len(r.text) and r.url == rows[k].url for k, r in got.items())
    made = [htmltext.TELLING.sub(r"<\1div", r.html) for r in rows.values()]
    model = htmltext.trained(pages.where("false"))
    assert np.mean([t == article(r.html) for t, r in zip(model.texts([dom.parsed(h) for h in made]), rows.values())]) > 0.95


def test_layouts_left_out_of_training():
    model = htmltext.fit([dom.parsed(htmltext.layout(random.Random(k)), htmltext.MARK) for k in range(300)])
    pages = [dom.parsed(htmltext.layout(random.Random(k)), htmltext.MARK) for k in range(1000, 1200)]
    right = [t == dom.joined(p, [x == 1 for x in p.labels]) for t, p in zip(model.texts(pages), pages)]
    assert np.mean(right) > 0.93


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.trained(spark.read.parquet(f"{SMALL}/pages.parquet"))


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("<nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One<b>two</b> &lt;three&gt;\n\tfour.<p>Five<br>six.</article><footer>&copy; us</footer>", "A & B Onetwo <three> four. Five six."),
        ("<body><div id=header><a href=x>Site</a></div><main><p>Text that is long enough to be read by someone.</p><section class='comments'><h3>Comments</h3><p>I do not agree with any of this at all.</p></section></main></body>", "Text that is long enough to be read by someone."),
        ("<article><p title='a > b'>Kept.</p><script>if (a < b) { x = '<p>no</p>' }</script><!-- <p>no</p> --><style>p{}</style><p>And kept, too.</p></article>", "Kept. And kept, too."),
        ("<article><p>Cut off in the mid<", "Cut off in the mid<"),
        ("<article><form><label>Name</label><input><button>Send</button></form><p>A sentence of the article follows the form here.</p></article>", "A sentence of the article follows the form here."),
        ("<div class='cookie-notice'><p>We use cookies on this site to make it better.</p></div><article><p>The article itself is here, for all to read.</p></article>", "The article itself is here, for all to read."),
    ],
)
def test_small_pages(model, html, text):
    assert model.texts([dom.parsed(html)]) == [text]


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "<article><p>Deep down there is a paragraph of some words.</p></article>" + "</div>" * 2000
    rows = [(1, None, None, 1), (1, None, None, 1), (2, "u", "", 1), (3, "u", deep, 1), (4, "u", "<<<< <a <b <c", 1), (5, "u", "<p " * 50_000, 1), (6, "u", "<svg>" * 20_000, 1), (None, "u", "<article><p>" + "long words " * 200_000 + "</p></article>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = htmltext.extracted(pages, model)
    assert got.columns == ["page_id", "url", "text"]
    found = {r.page_id: r.text for r in got.collect()}
    assert got.count() == 8 and found[1] == found[2] == found[5] == "" and found[None].count("long words") == 200_000
    assert found[3] == "Deep down there is a paragraph of some words."


# 13 vector codes


def test_nearest_entries_by_annulus():
    gen = np.random.default_rng(1)
    for _ in range(60):
        scale = gen.choice([2, 50, 1 << 20])
        e = gen.integers(-scale, scale + 1, (gen.integers(1, 65), gen.integers(1, 6)))
        q = np.vstack([gen.integers(-scale, scale + 1, (100, e.shape[1])), e])
        far = ((q[:, None] - e[None]) ** 2).sum(2)
        code, best = codes.Codebook(e).nearest(q)
        assert (code == far.argmin(1)).all() and (best == far.min(1)).all()


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, code int"


def ids_and_vectors():
    gen = np.random.default_rng(7)
    rows = [(k, [float(x) for x in gen.normal(size=32)], int(k % 3) if k % 7 else None, 0) for k in range(150)]
    bad = [float("nan"), float("inf"), None]
    return rows + [(k - 3, [x, *rows[0][1][1:]], 1, 0) for k, x in enumerate(bad)] + [(-9, None, 1, 0), (900, [1.0] * 15, 2, 0), (901, [], None, 0), (902, [3e38] * 32, 2, 0)] + rows[100:103]


def plain_codes(rows):
    """code and error by id, and codebooks, as the contract has them, by plain loops."""
    kept = sorted([(i, [int(np.floor(np.clip(float(np.float32(x)) * 256, -(1 << 26), 1 << 26))) for x in v], label) for i, v, label, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 32], key=lambda r: (r[0], r[1]))
    parts = [np.array([v[2 * p : 2 * p + 2] for _, v, _ in kept], np.int64) for p in range(16)]
    out, books = [], []
    for x in parts:
        c = x[:64].copy()
        for turn in range(3):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            a = d.argmin(1)
            if turn < 2:
                c = np.array([[int(s) // int((a == e).sum()) for s in x[a == e].sum(0)] if (a == e).any() else c[e] for e in range(len(c))])
        out.append((a, d.min(1)))
        books += c.ravel().tolist()
    return [(kept[k][0], "".join(f"{a[k]:02x}" for a, _ in out), int(sum(d[k] for _, d in out)), kept[k][2]) for k in range(len(kept))], hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("labels", [codes.LABELS, 1])
def test_codes(spark, tmp_path, monkeypatch, labels):
    """All of the query against loops, by either way to the errors of labels."""
    monkeypatch.setattr(codes.with_label_errors, "__defaults__", (labels, 4))
    rows = ids_and_vectors()
    spark.createDataFrame(rows, EMBEDDINGS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    expected, sha = plain_codes(rows)
    sums: dict = {}
    for *_, error, label in expected:
        sums[label] = sums.get(label, 0) + error
    want = [(i, c, e, sums[label], sha) for i, c, e, label in expected] + [(900, None, None, sums[2], sha), (901, None, None, sums[None], sha)]
    assert sorted(map(tuple, codes.op13_codes(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_codes_round_trip(spark):
    """Decoded vectors are as far from their own as the errors say."""
    rows = spark.createDataFrame([r[:3] for r in ids_and_vectors()[:150]], "id bigint, v array<float>, label int")
    whole = rows.withColumn("v", codes.whole_numbers(F.col("v")))
    books = codes.fitted(whole)
    coded = codes.encoded(whole, books)
    both = codes.decoded(coded, books).withColumnRenamed("v", "w").join(whole, "id").join(coded.select("id", "error"), "id")
    assert both.count() == 150 and all(sum((a - b) ** 2 for a, b in zip(r.v, r.w)) == r.error for r in both.collect())


def test_no_vector_can_be_cut(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0], 3, 0), (2, None, 3, 0)], EMBEDDINGS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in codes.op13_codes(spark, str(tmp_path)).collect()] == [(1, None, None, None, hashlib.sha256(b"").hexdigest())]


def test_codes_equal_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    same_rows(codes.op13_codes(spark, SMALL), con.sql(codes.OP13_SQL))
