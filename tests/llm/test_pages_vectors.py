"""Operators on pages and embeddings."""

import gzip
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.llm import embedding_dedup, html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site, the name of it, long enough to be text.</a></header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="ad">Buy this, now, or else. It is cheap, good, and yours.</div><article><h1>A &amp; B</h1><p>First   paragraph,
with <b>bold</b> text.<br><p>Second &lt;one&gt;, unclosed. <ul><li>item</ul><p>Be.<form><input> Sign in</form></article>
<aside>Also, read this long text, please.</aside><div id="comments"><p>I, a reader, agree with all of it.</p></div><footer>&copy; us</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A & B\nFirst paragraph, with bold text.\nSecond <one>, unclosed.\nitem\nBe."


def test_main_text_without_article():
    page = "<body><div><a>one</a> <a>two</a></div><div><p>" + "Long text, with marks. " * 9 + "</p><p>" + "More of it, again. " * 9 + "</p><p>End.</p></div><div><span>x</span></div></body>"
    got = html_extract.main_text(page).split("\n")
    assert len(got) == 3 and got[0].startswith("Long") and got[2] == "End."


def test_main_text_of_a_split_article():
    lead = "<p>" + "The lead, with marks. " * 8 + "</p>"
    body = "".join(f"<p>{i}, " + "More of it, again, in the body. " * 9 + "</p>" for i in range(6))
    page = f"<body><div class=nav><a>one</a> <a>two</a></div><div id=a><div>{lead}</div><div>{body}</div></div><div><span>x</span></div></body>"
    got = html_extract.main_text(page).split("\n")
    assert len(got) == 7 and got[0].startswith("The lead") and got[-1].startswith("5, More")


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!--", "</p>", "<script>", "plain", "<a href='", "<p>a<p>b</div>", "<table><tr><td>x<td>y", "\x00<p>\x00"])
def test_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str) and isinstance(html_extract.plain_text(page), str)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "<p>hi</p>" * 5000, "t")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and [r["text"] for r in got if r["page_id"] == 2] == [""]
    assert got[3]["text"].count("hi") == 5000 and len(got) == 4
    assert html_extract.extract(df.limit(0)).count() == 0


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>Hi &amp; bye</p><script>x</script>", 0), (2, None, None, 0), (1, "http://a/", "<p>Hi &amp; bye</p><script>x</script>", 0)], "page_id long, url string, html string, block int")
    sources = warc.responses_of_pages(pages)
    rows = [r.asDict() for r in warc.derive(sources).collect()]
    assert len(rows) == 6
    by_id = {r["record_id"]: r for r in sources.collect()}
    for r in rows:
        source = by_id[r["refers_to"]]
        assert (r["target_uri"], r["refers_date"], r["source_digest"]) == (source["target_uri"], source["date"], source["payload_digest"])
        (fields, block), = warc.parse_records(warc.serialise(r))
        assert block == r["block"] and fields["warc-refers-to"] == r["refers_to"] and fields["warc-type"] == r["type"] and fields["warc-block-digest"] == warc.digest(block)
        if r["type"] == "metadata":
            assert b"http-header-Content-Type: text/html; charset=utf-8\r\n" in block and source["payload_digest"].encode() in block
    assert {bytes(r["block"]) for r in rows if r["type"] == "conversion"} == {b"Hi & bye", b""}
    # A written file of gzip members reads back as the same responses.
    record = [warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]), ("WARC-Payload-Digest", r["payload_digest"])], r["block"]) for r in sources.collect()]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, record)))
    back = warc.read_responses(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], bytes(r["block"])) for r in back) == sorted((r["record_id"], bytes(r["block"])) for r in sources.collect())
    assert warc.derive(sources.limit(0)).count() == 0


def test_broken_payloads_and_missing_ids():
    text = ("words of a page. " * 500).encode()
    packed = gzip.compress(text)
    assert warc.inflated(packed) == text == warc.inflated(zlib.compress(text)) == warc.inflated(zlib.compress(text)[2:-4])
    assert text.startswith(warc.inflated(packed[: len(packed) // 2])) and warc.inflated(packed[: len(packed) // 2]) and warc.inflated(text) == text
    heads = [b"HTTP/1.1 200 OK\r\n\r\n" + x for x in (b"a", b"b")]
    assert len({r[0] for b in heads for r in warc.derive_one("", "", "", "", b)}) == 4
    broken = b"junk" + warc.record_bytes([("WARC-Type", "response")], b"x") + b"WARC/1.0\r\nContent-Length: many\r\n\r\n" + warc.record_bytes([("WARC-Type", "response")], b"y") + b"WARC/1.0\r\nno end"
    assert [b for f, b in warc.parse_records(broken) if f.get("warc-type")] == [b"x", b"y"]


def bare(page):
    """The page without any element or attribute that tells what it is for."""
    page = re.sub(r"<(/?)(article|main|nav|footer|header|aside|section)\b", r"<\1div", page)
    return re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_ratios_alone_find_the_main_text(monkeypatch):
    """On bare pages the scores are all there is: they find what the telling elements held, and constant scores don't."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    want = [Counter(html_extract.main_text(p).split()) for p in pages]

    def measured():
        got = [Counter(html_extract.main_text(bare(p)).split()) for p in pages]
        same = sum(sum((a & b).values()) for a, b in zip(want, got, strict=True))
        return same / sum(b.total() for b in got), same / sum(a.total() for a in want), sum(a == b for a, b in zip(want, got, strict=True)) / len(pages)

    precision, recall, exact = measured()
    assert precision > 0.99 and recall > 0.99 and exact > 0.9
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: np.ones(len(blocks)))
    precision, recall, exact = measured()
    assert precision < 0.95 and exact == 0


def vectors(rng):
    rows = []
    for _ in range(6):
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * s for s in rng.choice([0.02, 0.08, 0.15], 12)]
    rows += list(rng.normal(size=(150, 16)))
    return [v.tolist() for v in rows]


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(0)
    good = vectors(rng)
    rows = list(enumerate(good)) + [(900, good[0]), (901, [x * 3 for x in good[1]]), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, [None] + [1.0] * 15), (906, []), (907, [1.0, 2.0]), (908, [1.0, 2.0]), (None, good[0]), (909, [1e200] + [0.0] * 15), (910, [1e-200] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    unit = {i: embedding_dedup.unit(v) for i, v in rows if i is not None}
    links = {i: {j for j in unit if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    assert sum(map(len, links.values())) > 200
    got = embedding_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"]) == (0, None)
            continue
        seen, todo = {r["vec_id"]}, [r["vec_id"]]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[r["vec_id"]]), min(seen), r["vec_id"] == min(seen))
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 16))
    near = lambda v: (v + 0.01 * rng.standard_normal(16)).tolist()
    rows = [(1, x.tolist()), (1, y.tolist()), (2, near(x)), (3, near(y)), (4, None), (4, x.tolist())]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 2, 1, False)]


def test_passes_grow_slower_than_the_vectors():
    assert embedding_dedup.passes_for(0) == embedding_dedup.PASSES_LEAST
    assert embedding_dedup.passes_for(50_000) < embedding_dedup.passes_for(15_000_000) < 60


def cone(n, pairs, inner, dims=64, seed=3):
    """n vectors, a third of them in a cone of inner cosine ``inner`` that link with nothing but the partner planted for some."""
    rng = np.random.default_rng(seed)
    axis = np.eye(dims)[0]
    side = rng.standard_normal((n, dims))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = rng.standard_normal((n, dims))
    x[: n // 3] = math.sqrt(inner) * axis + math.sqrt(1 - inner) * side[: n // 3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = rng.standard_normal((pairs, dims))
    turn -= (turn * x[:pairs]).sum(1)[:, None] * x[:pairs]
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    return np.concatenate([x, 0.955 * x[:pairs] + math.sqrt(1 - 0.955**2) * turn])


@pytest.mark.parametrize("inner", [0.0, 0.9])
def test_links_in_a_dense_cone(spark, inner):
    n, pairs = 6000, 300
    x = cone(n, pairs, inner)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(df).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= k for i, k in enumerate(near.sum(1)))


def test_shared_signs():
    a = np.array([0, 1 << 61, 5, (1 << 62) - 1, 1 << 31])
    assert embedding_dedup.shared_signs(a, np.array([0, 0, 4, 0, (1 << 31) - 1])).tolist() == [62, 0, 61, 0, 30]
