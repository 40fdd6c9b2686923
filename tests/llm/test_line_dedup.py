from collections import Counter, defaultdict

from memlake.llm import line_dedup as ld

PAGES = "page_id long, url string, html string, host string, text string, __host string, __lines string, __dropped long"


def plain(rows):
    """rows (id, host, text) by plain counting; equal texts of a host are one."""
    bodies = {(h, t) for _, h, t in rows if t is not None}
    pages, holds = Counter(h for h, _ in bodies), defaultdict(int)
    for h, t in bodies:
        for x in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
            holds[h, x] += 1
    over = {k for k, n in holds.items() if n >= ld.LEAST and n - 1 > (pages[k[0]] - 1) * (ld.LONG_RATIO if k[1].count(" ") >= ld.LONG_WORDS - 1 else ld.RATIO)}
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in over)) for i, h, t in rows)


def test_against_plain_counts(spark):
    rows = [(i, f"h{i % 3}" if i % 10 else None, f"menu\nline {i}\n  menu \n\nshared {i % 20}\nfooter" if i % 4 else None if i % 8 else "") for i in range(300)]
    long = "a sentence of seven words, on few pages"
    rows += [(3000 + i, "big", f"page {i}\n{long}\r" if i % 50 == 0 else f"page {i}\nread on\t" if i % 50 == 1 else f"page {i}") for i in range(500)]
    rows += [(4000, "small", "home"), (4001, "small", "home\nthree of three"), (4002, "small", "home"), (4003, "small", "home\nalone"), (4100, "single", "kept whole"), (4101, "pair", "of two\na"), (4102, "pair", "of two\nb")]
    rows += [(i + 1000, "hot", "all the same\nunique " + str(i % 5)) for i in range(100)] + [(2000, "rare", "menu")] * 3
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = ld.drop_boilerplate(df)
    assert sorted((r.id, r.text) for r in got.collect()) == plain(rows)
    texts = {r.id: r.text for r in got.collect()}
    assert texts[3000] == "page 0" and texts[3001] == "page 1\nread on\t" and texts[4000] == "" and texts[4001] == "three of three" and texts[4100] == "kept whole" and texts[4102] == "of two\nb"
    forced = ld.BROADCAST_ROWS
    try:
        ld.BROADCAST_ROWS = 0  # the way without a broadcast
        assert sorted((r.id, r.text) for r in ld.drop_boilerplate(df).collect()) == plain(rows)
    finally:
        ld.BROADCAST_ROWS = forced


def test_pages_with_nulls_repeats_and_clashing_columns(spark, tables):
    html = "<html><head><title>t</title></head><body><nav>Home</nav><p>Text {}<br>more<script>x()</script></body>"
    data = [(i, "https://www.Site.org:80/a?b" if i % 2 else "http://other.net", html.format(i), "x", "y", "z", "w", 1) for i in range(40)]
    data += [(100, None, "<p>a", None, None, None, None, None), (101, "http://other.net", None, None, None, None, None, None), (102, "", "", None, None, None, None, None), data[0], data[0]]
    got = ld.op4_line_dedup(spark, tables(pages=(data, PAGES))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(data) and by[1].host == "www.site.org" and by[1].text.split() == ["Text", "1"] and (by[1].n_lines, by[1].n_dropped) == (3, 2)
    assert by[101].text is None and by[101].n_lines == 0 and by[100].host is None and by[100].text.strip() == "a"
    assert ld.op4_line_dedup(spark, tables(pages=([], PAGES))).collect() == []


def test_a_very_long_line(spark):
    rows = [(i, "a", "x" * 200_000 + "\n" + str(i)) for i in range(12)]
    got = ld.drop_boilerplate(spark.createDataFrame(rows, "id long, source string, text string")).collect()
    assert sorted((r.id, r.text) for r in got) == [(i, str(i)) for i in range(12)]


def test_copies_of_a_page_keep_their_text_on_hosts_of_any_size(spark):
    body = "What only this page and its copy say, in more than five words.\nshort\nAnd another sentence of its own here."
    rows = []
    for size in (2, 3, 10, 100, 1000):
        own = [(size * 10_000 + i, f"host{size}", f"menu\nPage {i} of this host says things of its own.\nfooter") for i in range(size - 2)]
        rows += own + [(size * 10_000 + 5000 + k, f"host{size}", body) for k in range(2)]
    rows += [(90_000_000 + i, "copies", body) for i in range(50)]
    got = {r.id: r.text for r in ld.drop_boilerplate(spark.createDataFrame(rows, "id long, source string, text string")).collect()}
    assert all(got[i] == body for i, _, t in rows if t == body)
    assert got[10_000_000] == "Page 0 of this host says things of its own." and got[30_000] == "menu\nPage 0 of this host says things of its own.\nfooter"
