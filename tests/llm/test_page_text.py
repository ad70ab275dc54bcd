import re
import time
from collections import Counter

from quayside.llm import page_text as P

SITE = "<html><body class='has-sidebar'><div class='menu'><a>Home</a></div><div class='x'><p>Site motto here</p></div>{}<div>All rights are reserved by us</div></body></html>"


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu</ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy</div><article class="post comments-open"><header>by line</header><h1>Head &amp; tail</h1><p><b>One  two<br>three<br><p>Four&nbsp;&lt;b&gt;</p>
    <div class="cookie-notice"><p>cookies</p></div><ul><li>i<li>j</ul><form><input><p>mail</p></form><section id="comments"><p>first!</p></section></article><aside>side</aside><footer>f</footer>"""
    text = P.main_text(P.lines_of(page), [])
    assert text == "Head & tail\n\nOne two three\n\nFour <b>\n\ni\n\nj"


def test_cut_off_pages_and_odd_markup():
    assert P.main_text(P.lines_of("<p>x &lt;div&gt; y</p><p>tail of &am"), []) == "x <div> y\n\ntail of &am"
    assert P.main_text(P.lines_of("<p>a < b and c > d</p><p cla"), []) == "a < b and c > d"
    assert P.main_text(P.lines_of(None), []) == P.main_text(P.lines_of(""), []) == ""
    assert P.main_text(P.lines_of("<p>x</p><script>never closed <p>y"), []) == "x"


def test_shared_lines_is_a_longest_common_subsequence():
    import random

    rng = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = sorted(P.shared_lines(a, b))
        assert len(got) == longest(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_large_alignments_are_halved(monkeypatch):
    import random

    rng = random.Random(9)
    for limit in (1, 40):
        monkeypatch.setattr(P, "TABLE_BITS", limit)
        for _ in range(60):
            a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 25))] for _ in range(2))
            got = sorted(P.shared_lines(a, b))
            it = iter(b)
            assert all(a[i] in it for i in got)
            with monkeypatch.context() as m:
                m.setattr(P, "TABLE_BITS", 1 << 26)
                assert len(P.shared_lines(a, b)) == len(got)
    monkeypatch.undo()
    a, b = ([f"line {rng.randrange(400)}" for _ in range(12_000)] for _ in range(2))
    began = time.time()
    got = P.shared_lines(a, b)
    it = iter(b)
    assert len(got) > 1_000 and all(a[i] in it for i in sorted(got)) and time.time() - began < 20


def test_unclosed_tags_are_read_in_linear_time():
    began = time.time()
    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<div>" + "<b>" * 60_000 + "<li>x" * 60_000, "<p><div>" * 40_000 + "<hr>" * 40_000):
        P.lines_of(page)
    assert time.time() - began < 5


def differenced(rows):
    """Text of each row by plain loops over all pages."""
    sites = {}
    for _, url, html, *_ in rows:
        host = re.sub(r"(?s)^.*?://([^/?#]*).*", r"\1", url).lower() if url and "://" in url else ""
        path = re.sub(r"(?s)^.*?://[^/?#]*([^?#]*).*", r"\1", url) if host else ""
        lines = tuple(x.text for x in P.lines_of(html))
        if host:
            known = sites.setdefault(host, {})
            known[lines] = min(known.get(lines, path), path)
    out = []
    for _, url, html, *_ in rows:
        host = re.sub(r"(?s)^.*?://([^/?#]*).*", r"\1", url).lower() if url and "://" in url else ""
        found = P.lines_of(html)
        own = tuple(x.text for x in found)
        near, votes = [], Counter()
        if host:
            order = sorted(sites[host], key=lambda x: (sites[host][x].encode(), P.digest_of(P.line_codes([P.Line(t, "") for t in x]))))
            k = order.index(own)
            near = order[max(0, k - 2) : k] + order[k + 1 : k + 3]
        for other in near:
            got = P.shared_lines(list(own), list(other))
            if len(near) > 1 or sum(len(own[i]) for i in got) <= 0.8 * sum(map(len, own)):
                votes.update(got)
        out.append("\n\n".join(x.text for i, x in enumerate(found) if x.place == "in" or x.place == "open" and not (votes[i] and 2 * votes[i] >= len(near))))
    return out


def test_differencing_alone_finds_the_article(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)  # many blocks, which hosts cross
    rows = [(i, f"http://h.org/a/{i:03}", SITE.format(f"<div><p>Story number {i} is told</p><p>and ends {i}</p></div>"), "clash") for i in range(40)]
    rows += [(100, "http://other.org/", SITE.format("<p>alone</p>"), ""), (101, None, None, ""), (102, "http://h.org/a/001", "", ""), rows[3], (None, "http://h.org/a/0015", SITE.format("<p>no id</p>"), "")]
    rows += [(200 + i, f"http://h.org/a/003?copy={i}", rows[3][2], "") for i in range(30)]  # copies of one page are no neighbours of it
    rows += [(300, "http://two.org/a", "<p>same text here</p><p>x</p>", ""), (301, "http://two.org/b", "<p>same text here</p><p>y</p>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = sorted(zip((-1 if r[0] is None else r[0] for r in rows), differenced(rows), strict=True))
    for parts in (1, 7):
        out = P.extract_main_text(df.repartition(parts)).collect()
        assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in out) == want
    got = {r.page_id: r.text for r in out}
    assert all(got[i] == f"Story number {i} is told\n\nand ends {i}" for i in range(40))
    assert got[None] == "no id" and got[101] == got[102] == "" and "alone" in got[100] and got[300] == "same text here\n\nx"
    assert all(r.n_lines - r.n_shared == 2 for r in out if r.page_id is not None and r.page_id < 40)
    assert P.extract_main_text(df.limit(0)).count() == 0


def test_pages_of_the_given_tables_against_plain_loops(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    pages = spark.read.parquet(path)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = {(r.page_id, r.text) for r in P.extract_main_text(pages).collect()}
    assert got == {(r[0], t) for r, t in zip(rows, differenced(rows), strict=True)}


def test_article_pages_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://h.org/{i}", f"<nav>n</nav><article><p>Shared paragraph</p><p>{i % 3}</p></article>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in P.extract_main_text(df.repartition(5)).collect()} == {i: f"Shared paragraph\n\n{i % 3}" for i in range(30)}
