"""HTML extraction, WARC and nearest neighbours."""

import base64
import gzip
import hashlib
import html
import re

import numpy as np
import pyarrow.parquet as pq

from boxloom.llm import ann, queries, warc, wrappers


def slow_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br|div|ul|li)\b[^>]*>", inner)
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)


def test_articles_of_a_table(spark, small):
    table = pq.read_table(f"{small}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in queries.op5_html_extraction(spark, small).collect()}
    assert len(got) == len(table)
    for p in table:
        assert got[p["page_id"]]["text"] == slow_article(p["html"]) and got[p["page_id"]]["n_chars"] == len(slow_article(p["html"]))


PAGE = """<html><head><title>T</title><style>x</style></head><body><header>Site</header><div class="cookie-notice">We use</div>
<div id="wrap"><div class="post-body"><h1>Head &amp; line</h1><p>One <b>bo</b>ld<br>text %s</p><ul><li>a<li>b</ul><!-- no --><script>if (a<b) "</p>";</script><p>Two &lt;p&gt; 1 < 2</p></div>
<aside>Side</aside><section class="comments"><p>Great post, a long comment by a reader of this page</p></section></div><form>Go</form><footer>&copy;</footer></body></html>"""


def test_pages_without_article(spark):
    rows = [(i, f"https://h.example/{i}", PAGE % i) for i in range(4)]
    rows += [(10, None, None), (11, "odd", ""), (12, "https://h.example/x", "plain &eacute; text"), (12, "https://h.example/x", "plain &eacute; text"), (13, "http://k.example/", "<div>" * 3000 + "deep <i>te</i>xt" + "</div>" * 3000), (14, "http://k.example/", '<p class="a>b')]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, wrapper string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert all(got[i] == f"Head & line One bold text {i} a b Two <p> 1 < 2" for i in range(4))
    assert got[10] == "" == got[11] and got[12] == "plain é text" and got[13] == "deep text"
    assert wrappers.main_text(pages).count() == len(rows)
    assert not wrappers.main_text(pages.where("false")).collect()


def texts(page):
    return [t for _, t in wrappers.Page(page).texts]


def test_quotes_in_tags():
    page = """<div title="don't > stop" x=it's><p data-a='"' b="1">one</p><p don't>two's</p><p c="open>three</p><p>4 < 5 & six</p></div>"""
    assert texts(page) == ["one", "two's", "three", "4 < 5 & six"]
    assert texts("a <b" + "<i x=\"" * 3000) == ["a"]
    for n in (60_000, 200_000):
        assert texts(f"""<p>a</p><div data-x="{'x' * n} before</article> b leaked"><p>after</p></div>""") == ["a", "after"]
    assert texts("<p a='" * 50_000 + "'>x</p>") == ["x"]


def test_deep_pages():
    deep = "<div>" * 20_000 + "<b>" * 20_000 + "deep" + "<li>x" * 5_000 + "<p>y" * 5_000
    assert texts(deep) == ["deep", *["x"] * 5_000, *["y"] * 5_000]
    assert " ".join(texts(deep)).endswith(wrappers.extract(deep, None)) and wrappers.extract(deep, None)
    paths = "".join(f"<div class=c{i}>t{i}" for i in range(3000))
    assert wrappers.extract(paths, None).endswith("t2998 t2999")


def test_wrappers_fold_lists_and_options():
    one, two = (wrappers.infer(wrappers.Page(p)) for p in ("<ul><li>a</li><li>b</li></ul><p>x</p><i>z</i>", "<ul><li>a</li></ul><h2>new</h2><p>y</p>z"))
    both = wrappers.align(one, two)
    parts = {p[wrappers.KEY]: p for p in both["n"]}
    assert list(parts) == ["", "ul", "li", "p", "h2"] and [p[wrappers.PAGES] for p in both["n"]] == [2, 2, 2, 2, 1]
    assert parts["li"][wrappers.REPEATED] and not parts["p"][wrappers.REPEATED]
    # A literal stays where all have it; what differs is a slot.
    assert parts["li"][wrappers.LITERALS] == {wrappers._hash("a"): 1} and parts["p"][wrappers.LITERALS] == {} and parts[""][wrappers.LITERALS] == {wrappers._hash("z"): 1}
    assert wrappers._unpacked(wrappers._packed(both)) == both


def test_alignment_does_not_depend_on_the_order():
    pages = [f"<div><p>same</p><p>text {i}</p>{'<ul><li>x</ul>' if i % 2 else ''}{'<h2>odd</h2>' if i == 5 else ''}</div>" for i in range(8)]

    def said(order):
        w = wrappers.infer(wrappers.Page(pages[order[0]]))
        for i in order[1:]:
            w = wrappers.align(w, wrappers.infer(wrappers.Page(pages[i])))
        return {k: sorted(map(str, v)) for k, v in wrappers.rule(w).items()}

    assert said(range(8)) == said([5, 3, 0, 7, 1, 2, 6, 4])


def site(middle, cls="page"):
    return f"""<body><div class="{cls}"><div class="top"><a>Home</a> <a>About</a></div>{middle}<div class="box"><p>All rights reserved by the same owner of this site since long ago</p></div></div></body>"""


def host_texts(spark, pages):
    df = spark.createDataFrame([(i, "https://s.example/a", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrappers.main_text(df).orderBy("page_id").collect()]


def test_literals_and_slots_decide(spark):
    """Text that all pages of a host have goes, although no tag or class tells; frames named like asides stay."""
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    for cls in ("page", "content no-sidebar", "page with-header-image", "comments-open search-page layout"):
        if "comments" in cls:
            pages = [site(f"<article><h1>Title {i}</h1><p>{words[i]}</p><p>Follow us for more of this</p></article>", cls) for i in range(20)]
        else:
            pages = [site(f"<div class=x><h2>Title {i}</h2><p>{words[i]}</p><p>Follow us for more of this</p></div>", cls) for i in range(20)]
        assert host_texts(spark, pages) == [f"Title {i} {words[i]}" for i in range(20)]
    alone = wrappers.extract(pages[0], None)
    assert "Follow us" in alone  # one page has no wrapper that could tell
    # Copies of one page prove nothing: all its text would be literal.
    assert set(host_texts(spark, pages[:1] * 20)) == {alone}
    comments = [site(f"<div class=x><p>{words[i]}</p></div><div class='comments'><article class='comment'><p>{words[i + 1] * 5}</p></article></div>") for i in range(10)]
    assert host_texts(spark, comments) == words[:10]


def test_warc_of_a_table(spark, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    top = {}
    for p in pages:
        sha = base64.b32encode(hashlib.sha1((p["html"] or "").encode()).digest()).decode()
        top[sha] = max(top.get(sha, -1), p["page_id"])
    got = {r["page_id"]: r for r in queries.op7_warc(spark, small).collect()}
    assert len(got) == len(pages)
    for p in pages:
        raw, r = (p["html"] or "").encode(), got[p["page_id"]]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), sha)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top[sha] == p["page_id"] else ("revisit", top[sha]))


def test_warc_odd_rows(spark):
    rows = [(1, "u\r\nx", None), (2, None, ""), (3, "a", "same"), (4, "b", "same"), (None, "c", "same"), (5, "d", "é\x00WARC/1.1\r\n"), (5, "d", "é\x00WARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha string")
    archives = warc.write_archives(warc.plan(pages), archive_bytes=300)
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(archives).collect())
    assert got == [(-1, "revisit", 4, 4), (1, "revisit", 2, 0), (2, "response", None, 0), (3, "revisit", 4, 4), (4, "response", None, 4), (5, "response", None, 13), (5, "response", None, 13)]
    small = warc.plan(pages, min_bytes=5).where("refers_to is not null").count()
    assert small == 0
    assert not warc.read_archives(warc.write_archives(warc.plan(pages.where("false")))).collect()


def test_ids_are_any_longs(spark):
    ids = [10**18, 2**63 - 1, -(2**63), -1, 0]
    pages = spark.createDataFrame([(i, f"https://x.example/{i}", "same") for i in ids], "page_id long, url string, html string")
    archives = warc.write_archives(warc.plan(pages, min_bytes=0))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect()}
    assert got == {i: ("response", None) if i == max(ids) else ("revisit", max(ids)) for i in ids}


def test_archives_are_files(spark):
    """Any gzip reader opens them."""
    pages = spark.createDataFrame([(i, f"https://x.example/{i}", f"page {i}") for i in range(30)], "page_id long, url string, html string")
    files = [r["path"] for r in warc.write_archives(warc.plan(pages), archive_bytes=500).collect()]
    raw = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files)
    assert len(files) > 1 and all(f.endswith(".warc.gz") for f in files) and raw.count(b"WARC/1.1\r\n") == 30


def test_salvage_of_damage():
    raw = [warc.record(i, f"u{i}", f"payload {i}".encode() * 50, warc.digest(f"payload {i}".encode() * 50)) for i in range(6)]
    members = [warc.member(r) for r in raw]
    members[1] = members[1][:20] + b"\0\0\0" + members[1][23:]
    members[3] = members[3][: len(members[3]) // 2]
    content = b"".join(members[:5]) + raw[5] + b"junk"
    records, gaps = warc.salvage(content)
    assert [r["warc-record-id"] for r in records] == [f"<urn:page:{i}>" for i in (0, 2, 4, 5)]
    at = [sum(map(len, members[:i])) for i in range(6)]
    assert [(s, e) for s, e, _ in gaps] == [(at[1], at[2]), (at[3], at[4]), (len(content) - 4, len(content))]
    lied = warc.member(warc.record(1, "u", b"abc", warc.digest(b"abd"))) + members[0]
    assert [len(x) for x in warc.salvage(lied)] == [1, 1]
    plain = raw[0] + raw[1][:-30] + raw[2]
    assert [r["warc-target-uri"] for r in warc.salvage(plain)[0]] == ["u0", "u2"]


def test_salvage_inside_a_member():
    """Records before and after a bad one of the same member come through, and those before a cut."""
    raw = [warc.record(i, f"u{i}", f"payload {i} ".encode() * 40, warc.digest(f"payload {i} ".encode() * 40)) for i in range(5)]
    urls = lambda content: [r["warc-target-uri"] for r in warc.salvage(content)[0]]
    bad = [*raw[:2], raw[2].replace(b"payload 2", b"payload X", 1), *raw[3:]]
    one = warc.member(b"".join(bad))
    records, gaps = warc.salvage(one)
    assert [r["warc-target-uri"] for r in records] == ["u0", "u1", "u3", "u4"]
    start = len(raw[0]) + len(raw[1])
    assert gaps == [(0, len(one), f"digest differs at {start}-{start + len(raw[2])} of the inflated bytes")]
    whole = warc.member(b"".join(raw))
    assert urls(whole[:-12]) == ["u0", "u1", "u2", "u3"] or urls(whole[:-12]) == [f"u{i}" for i in range(5)]
    assert len(warc.salvage(whole[:-12])[1]) == 1 and urls(whole[:-12] + warc.member(raw[4]))[-1] == "u4"
    noise = np.random.default_rng(3).bytes(60_000)
    big = [warc.record(i, f"u{i}", noise + bytes([i]), warc.digest(noise + bytes([i]))) for i in range(5)]
    whole = warc.member(b"".join(big))
    at = len(whole) // 2
    broken = whole[:at] + bytes(64) + whole[at + 64 :]
    assert urls(broken)[:2] == ["u0", "u1"] and urls(broken + warc.member(raw[3]))[-1] == "u3" and warc.salvage(broken)[1]
    # Each damaged byte loses no record but its own, wherever it is.
    members = [warc.member(r) for r in raw]
    for at in range(0, len(members[2]), 7):
        hurt = members[2][:at] + bytes([members[2][at] ^ 0x55]) + members[2][at + 1 :]
        assert [u for u in urls(b"".join([*members[:2], hurt, *members[3:]])) if u != "u2"] == ["u0", "u1", "u3", "u4"]


def test_foreign_headers(spark):
    good = warc.record(7, "u", b"abc", warc.digest(b"abc"))
    odd = [good.replace(b"X-Payload-Length: 3", b"X-Payload-Length: many"), good.replace(b"urn:page:7", b"urn:page:" + b"9" * 40), good.replace(b"Content-Length: 3", b"Content-Length: \xc2\xb2")]
    archives = spark.createDataFrame([(str(i), bytearray(warc.member(o))) for i, o in enumerate(odd)], "path string, content binary")
    got = sorted((str(r["page_id"]), r["payload_bytes"]) for r in warc.read_archives(archives).collect())
    assert got == [("7", 3), ("None", 3)]


def test_gaps_are_logged(spark):
    good = warc.member(warc.record(1, "u", b"abc", warc.digest(b"abc")))
    archives = spark.createDataFrame([("x", bytearray(b"bad!" + good)), ("y", bytearray(good)), ("z", None)], "path string, content binary")
    assert [tuple(r) for r in warc.read_archives(archives, gaps=True).collect()] == [("x", 0, 4, "no version line")]
    assert warc.read_archives(archives).count() == 2


def brute(ids, x, asked, k):
    scores = x[asked] @ x.T
    out = {}
    for row, i in zip(scores, np.flatnonzero(asked), strict=True):
        own = ids != ids[i]
        order = np.lexsort((ids[own], -row[own]))[:k]
        out[int(ids[i])] = ids[own][order].tolist()
    return out


def clustered(n, seed):
    """Unit vectors in tight groups of about 40."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(max(n // 40, 1), 64))[rng.integers(0, max(n // 40, 1), n)] + rng.normal(size=(n, 64)) * 0.05
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def expect_neighbours(spark, ids, x, least):
    want = brute(ids, x, ids % 20 == 0, 20)
    where = {int(d): i for i, d in enumerate(ids)}
    by = {}
    for r in ann.search(spark.createDataFrame(zip(ids.tolist(), x.tolist(), strict=True), "vec_id long, embedding array<double>"), queries.F.col("id") % 20 == 0, k=20).collect():
        by.setdefault(r["query_id"], []).append(r)
        assert abs(r["score"] - x[where[r["query_id"]]] @ x[where[r["vec_id"]]]) < 1e-9
    assert set(by) == set(want)
    found = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        found += len({r["vec_id"] for r in rows} & set(want[q]))
    assert found / (20 * len(want)) >= least


def test_recall_and_scores(spark, small):
    table = pq.read_table(f"{small}/embeddings.parquet")
    expect_neighbours(spark, table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), dtype=np.float64), 0.95)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    expect_neighbours(spark, np.arange(6000), x / np.linalg.norm(x, axis=1, keepdims=True), 0.95)
    expect_neighbours(spark, np.arange(4000), clustered(4000, 5), 0.95)


def test_substring_index_holds_all_codes_within_the_radius():
    """The pigeonhole probes find the codes that a comparison of all finds, and open few entries where codes are close."""
    x = clustered(5000, 6)
    model = ann.learn(x[:1000])
    codes = ann.encode(x, *model)
    index = ann.MultiIndex(np.arange(5000), x, codes)
    far = ann.differing(codes[:100], codes)
    for radius in (0, 5, 16, 20, 31):
        a, b = index.candidates(codes[:100], radius)
        assert set(zip(*np.nonzero(far <= radius), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(a) < 100 * 5000 / 5
    assert index.candidates(codes[:100], 120) is None
    for radius in (5, 20, 120):
        got = index.search(np.arange(100), x[:100], codes[:100], radius, 10)
        for q in range(100):
            limit = max(radius, np.partition(np.delete(far[q], q), 9)[9])
            near = [j for j in np.flatnonzero(far[q] <= limit) if j != q]
            scores = x[near] @ x[q]
            assert got[1][got[0] == q].tolist() == [near[i] for i in np.lexsort((near, -scores))[:10]]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (40, [])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.search(v, queries.F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert not ann.search(v.where("false"), queries.F.col("id") % 20 == 0).collect()
    assert not ann.search(v.where("vec_id = 3"), queries.F.col("id") % 20 == 0).collect()
