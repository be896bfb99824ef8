"""Operators on pages and vectors against brute force."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import caps, extract, link_rank, topk, warc
from loadlens.session import scratch_path


# --- top-k -----------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x", 2.0) for i, v in rows],
        "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING, score DOUBLE",
    )


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    data[100:140] = data[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 14), (902, [float("nan")] * 16),
           (903, [float("inf")] * 16), (None, rows[0][1]), (950, []), (0, rows[0][1]), (951, [9.0])]
    df = topk.quantised(vectors(spark, rows + odd))
    got = topk.top_k(df, df.where(F.col("id") % 50 == 0), 5, block_rows=300, query_rows=4).collect()
    sound = {i: np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64) for i, v in rows}
    sound |= {950: np.zeros(16, dtype=np.int64), 951: np.array([2304] + [0] * 15)}
    wanted = []
    for q in (i for i in sound if i % 50 == 0):
        scores = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q)[:5]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_index_proves_its_stop():
    rng = np.random.default_rng(9)
    matrix = np.floor(rng.normal(0, 32, (3000, 32))).astype(np.int32)
    built = topk.ImpactIndex(np.arange(3000), matrix)
    for q in range(0, 3000, 300):
        left = built._survivors(matrix[q].astype(np.int64), q, 5)
        assert len(left) < 3000
        scores = matrix.astype(np.int64) @ matrix[q]
        scores[q] = -(1 << 60)
        best = np.lexsort((np.arange(3000), -scores))[:5]
        assert set(best) <= set(left)


def test_top_k_of_nothing(spark):
    df = topk.quantised(vectors(spark, []))
    assert topk.top_k(df, df, 5).count() == 0


# --- spherical caps ------------------------------------------------------------------


def test_cap_filters_recall_and_counts(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 64))
    near = base[:60] + rng.normal(size=(60, 64)) * 0.25
    group = base[0] + rng.normal(size=(40, 64)) * 0.05
    data = np.concatenate([base, near, group, base[:5], base[:1]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None] * 64), (1004, [1.0])]
    got = {r.vec_id: r for r in caps.near_duplicates(vectors(spark, rows + odd)).collect()}
    unit = data.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    counts = close.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(data))])
    assert (found <= counts).all() and found.sum() >= 0.9 * counts.sum()
    for i in (1000, 1001, 1002, 1003, 1004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[220].component_id == 0 and not got[220].kept and got[0].kept


def test_cap_recall_at_the_limit():
    rng = np.random.default_rng(3)
    x = caps._unit(rng.normal(size=(1500, 64)))
    y = rng.normal(size=x.shape)
    y = caps._unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    sets = []
    for side in (x, y):
        own = [set() for _ in range(len(side))]
        for row, key in zip(*(a.tolist() for a in caps.filters_of(side))):
            own[row].add(key)
        sets.append(own)
    assert np.mean([bool(a & b) for a, b in zip(*sets)]) > 0.95


@pytest.mark.parametrize("rows", [300, 1 << 14, 1 << 36])
@pytest.mark.parametrize("dim", [2, 3, 4, 8, 16, 32, 96, 384, 1024])
def test_cap_recall_in_any_dimension(dim, rows):
    rng = np.random.default_rng(dim)
    x = caps._unit(rng.normal(size=(400, dim)))
    y = rng.normal(size=x.shape)
    y = caps._unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    sets = []
    for side in (x, y):
        row, key = caps.filters_of(side, rows)
        assert len(row) <= 1.2 * caps.MOST_FILTERS * len(side)
        sets.append(set(zip(row.tolist(), key.tolist())))
    assert len({row for row, _ in sets[0] & sets[1]}) >= 0.95 * len(x)


def test_cap_areas():
    rng = np.random.default_rng(8)
    for dim, limit in ((2, 0.7), (3, 0.5), (16, 0.3), (64, 0.2)):
        f = caps._unit(rng.normal(size=(200_000, dim)))
        one, both = caps.cap_shares(dim, limit, 0.9)
        x, y = f[:, 0] >= limit, 0.9 * f[:, 0] + np.sqrt(0.19) * f[:, 1] >= limit
        assert abs(x.mean() - one) < 0.005 and abs((x & y).mean() - both) < 0.005


def test_caps_of_nothing(spark):
    assert caps.near_duplicates(vectors(spark, [])).count() == 0


# --- urls ---------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, u, h, "x", 1) for i, u, h in rows],
        "page_id BIGINT, url STRING, html STRING, host STRING, trust INT",
    )


def test_rules(spark):
    cases = [
        ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://x.org/", "x.org", "/", "org/", "allow"),
        ("http://org.net/", "org.net", "/", None, "allow"),
        ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("http://É.com/fr/", "É.com", "/fr/", "com/fr/", "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://", "", "", None, "allow"), ("://q.org/?a://b", "q.org", "/", "org/", "allow"),
    ]
    got = link_rank.filter_urls(pages(spark, [(i, c[0], None) for i, c in enumerate(cases)])).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert found == {i: c[1:] for i, c in enumerate(cases)}


def test_trust_and_distrust_follow_links(spark):
    link = '<p><A class=x HREF="{}">t</A>'.format
    rows = [
        (1, "http://good.org/", link("http://friend.net/x")),
        (2, "http://friend.net/a", None), (3, "http://bad.com/de/1", link("/local")),
        (4, "http://farm.net/", link("//BAD.com/de/1") + link("https://bad.com/")),
        (5, "http://farm2.net/", link("http://farm.net/")), (6, "http://lone.net/", ""),
        (7, "http://bad.com/en/", None), (7, "http://bad.com/en/", None),
    ]
    got = link_rank.filter_urls(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    host = {r.host: r for r in got}
    assert host["friend.net"].verdict == "allow" and host["friend.net"].trust > 0
    assert host["farm.net"].verdict == "block" and host["farm2.net"].verdict == "block"
    assert host["lone.net"].verdict == "allow" and host["bad.com"].verdict == "block"
    # Against the closed form: s = 0.15 * seed + 0.85 * in.
    assert host["farm.net"].distrust == pytest.approx(0.85 * 0.15)
    assert host["farm2.net"].distrust == pytest.approx(0.85 ** 2 * 0.15)


def test_no_urls(spark):
    assert link_rank.filter_urls(pages(spark, [])).count() == 0


# --- archives --------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    long = "é\r\n\r\n" * 60
    rows = [(5, "http://a/1", long), (2, "http://a/\r\n2", long), (9, None, long), (9, None, long),
            (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 100_000),
            (8, "u", "\n\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (10, "u", "x" * 99), (11, "u", "x" * 99)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        payload = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        first = min(i for i, p in texts.items() if p == payload)
        revisit = len(payload) >= 100 and first != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_index_points_at_members(spark):
    folder, members = scratch_path(spark, "w"), scratch_path(spark, "m")
    warc.write_archives(warc.records(pages(spark, [(i, "u", "text %d" % i) for i in range(30)])), folder, 7)
    index = warc.normalise(spark, folder, members).collect()
    assert len(index) == 30
    for r in index:
        with open(f"{members}/{r.file}", "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")


def test_a_folder_of_members_is_read_without_more(spark):
    folder, members = scratch_path(spark, "w"), scratch_path(spark, "m")
    warc.write_archives(warc.records(pages(spark, [(i, "u", "text %d" % i) for i in range(30)])), folder, 7)
    with open(f"{folder}/other.warc", "w") as f:
        f.write("WARC/1.1\r\nnot an archive of gzip")
    warc.normalise(spark, folder, members)
    index = warc.archive_index(spark, members)
    found = warc.read_records(index, members).collect()
    assert sorted(r.page_id for r in found) == list(range(30))
    # An archive is not written over.
    with pytest.raises(Exception, match="(?i)already exists"):
        warc.normalise(spark, folder, members)
    assert warc.read_records(warc.archive_index(spark, members), members).count() == 30


def test_folders_are_named_as_the_file_system_wants():
    assert warc.member_uri("/data/x") == "file:///data/x"
    assert warc.member_uri("file:///data/x") == "file:///data/x"
    with pytest.raises(Exception):
        warc.member_uri("unknown://data/x")


def test_broken_stream_fails(spark, tmp_path):
    with gzip.open(tmp_path / "cut.warc.gz", "wb") as f:
        f.write(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nabc\r\n")
    with pytest.raises(Exception, match="breaks off"):
        warc.normalise(spark, str(tmp_path), scratch_path(spark, "m")).count()


def test_no_pages_no_archives(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


# --- main text -----------------------------------------------------------------------------------


def test_article_without_its_surroundings():
    html = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>x</p>'</script></head><body>"
        "<header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad box'>Buy</div>"
        "<div id=cookie-notice>We use cookies, a long sentence about them that goes on and on</div>"
        "<article><h1>A  &amp; B</h1><p>First <b>bold</b>\n text&nbsp;here.<p>ok</p>"
        "<form><p>Mail</p></form><aside>See also</aside><p>Last &lt;one&gt;.</p>"
        "<section class=comments><p>I disagree with this long article for many reasons</p></section>"
        "</article><footer>&copy; us</footer></body></html>"
    )
    assert extract.main_text(html) == "A & B\nFirst bold text here.\nok\nLast <one>."


def test_ratio_decides_without_markup():
    body = "".join(f"<p>{'A long paragraph of the main text. ' * 6}</p>" for _ in range(5))
    links = "".join(f"<div><span><a href=/{n}>l{n}</a></span></div>" for n in range(12))
    text = extract.main_text(f"<body>{links}{body}{links}</body>")
    assert text == "\n".join(["A long paragraph of the main text. " * 5 + "A long paragraph of the main text."] * 5)


PROSE = "A long paragraph of the main text. " * 6


def test_ratio_decides_within_an_article():
    links = "".join(f"<li><a href=/{n}>A linked title of another page {n}</a></li>" for n in range(8))
    html = f"<article><h1><a href=/>T</a></h1><p>{PROSE}</p><p>To.</p><ul>{links}</ul><p>{PROSE}</p></article>"
    lines = extract.main_text(html).split("\n")
    assert lines[0] == "T" and "To." in lines and lines.count(PROSE.strip()) == 2
    assert not any("another page" in line for line in lines)
    buttons = f"<article><p>{PROSE}</p><div class=share><a href=/t>Post</a> <a href=/m>Mail</a></div></article>"
    assert extract.main_text(buttons) == PROSE.strip()


def test_smoothing_carries_a_linked_line_between_paragraphs():
    html = f"<article><p>{PROSE}</p><p><a href=/s>The linked source</a></p><p>{PROSE}</p></article>"
    parser = extract.LineParser()
    parser.feed(html)
    parser.close()
    assert extract.content_lines(parser.lines) == [0, 1, 2]
    assert extract.content_lines(parser.lines, sigma=0) == [0, 2]


def test_an_article_loses_none_of_its_short_lines():
    rng = np.random.default_rng(11)
    for _ in range(60):
        lines = ["w" * int(n) for n in rng.choice([1, 2, 3, 9, 400, 5000], 30)]
        body = "".join(f"<{tag}>{line}</{tag}>" for tag, line in zip(rng.choice(["p", "h2", "blockquote"], 30), lines))
        html = f"<nav><a href=/>Home</a></nav><article>{body}</article><footer>{PROSE}</footer>"
        assert extract.main_text(html) == "\n".join(lines)


@pytest.mark.parametrize("name, kept", [
    ("content no-sidebar", True), ("post-header", True), ("share price", True), ("padding", True),
    ("commentary", True), ("has-ads", True), ("", True), ("sidebar", False), ("left-sidebar", False),
    ("comment-list", False), ("cookie_notice", False), ("box ad", False)])
def test_class_names_are_compared_word_by_word(name, kept):
    inner = f"<p>{PROSE}</p><div class='{name}'><p>Kept or not, as its class says it, at some length.</p></div><p>{PROSE}</p>"
    text = extract.main_text(f"<article>{inner}</article>")
    assert ("Kept or not" in text) == kept and text.count(PROSE.strip()) == 2


@pytest.mark.parametrize("html", [None, "", "<br><p></p>", "<script>only</script>", "<", "&amp", "<p"])
def test_pages_without_text(html):
    assert extract.main_text(html) in ("", "&", "<", "<p")


def test_extract_rows(spark):
    got = extract.extract(pages(spark, [(1, "u", "<p>é x</p>"), (1, "u", "<p>é x</p>"), (None, None, None)])).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "é x", 3)] * 2 + [("None", "", 0)]
    assert extract.extract(pages(spark, [])).count() == 0


# --- repeated ids, cycles ---------------------------------------------------------------


def test_top_k_where_an_id_repeats_with_other_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(50, rng.normal(size=8).tolist()) for _ in range(40)] + [
        (i, rng.normal(size=8).tolist()) for i in range(100, 130)]
    df = topk.quantised(vectors(spark, rows))
    got = topk.top_k(df, df.where("id = 50"), 5).collect()
    whole = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(np.int64)) for i, v in rows]
    wanted = sorted((-int(q @ v), i) for n, q in whole if n == 50 for i, v in whole if i != 50)[:5]
    assert [(r["rank"], -r.score) for r in got] == [(n + 1, s) for n, (s, _) in enumerate(wanted)]


def test_propagation_on_a_cyclic_graph_meets_brute_force(spark):
    rng = np.random.default_rng(1)
    count = 30
    shares = rng.random((count, count)) * (rng.random((count, count)) < 0.15)
    shares[np.arange(count), (np.arange(count) + 1) % count] = 1.0
    shares /= shares.sum(axis=1, keepdims=True)
    seed = (rng.random(count) < 0.2).astype(float)
    edges = spark.createDataFrame(
        [(str(a), str(b), float(shares[a, b])) for a, b in zip(*np.nonzero(shares))],
        "src STRING, dst STRING, share DOUBLE")
    seeds = spark.createDataFrame([(str(i), float(s)) for i, s in enumerate(seed)], "node STRING, seed DOUBLE")
    exact = np.linalg.solve(np.eye(count) - 0.85 * shares.T, 0.15 * seed)
    found = {r.node: r.score for r in link_rank.propagate(seeds, edges).collect()}
    assert max(abs(found[str(i)] - exact[i]) for i in range(count)) < 1e-5


def test_a_host_counts_once_however_a_page_spells_it(spark):
    html = '<a href="http://BAD.com/x"></a><a href="https://bad.com/y"></a>'
    pages = spark.createDataFrame([(1, "http://good.org/", html)], "page_id BIGINT, url STRING, html STRING")
    assert [tuple(r) for r in link_rank.host_links(pages).collect()] == [("good.org", "bad.com", 1)]
