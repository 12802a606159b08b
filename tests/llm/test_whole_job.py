"""What the operators once left out."""

from __future__ import annotations

import numpy as np

from hitframe.llm import template_html
from hitframe.llm.shingles import bands_of, block_count, similar, sketch_keys


def texts(spark, pages: list[str]) -> list[str]:
    rows = [(i, "http://h.example/x", p) for i, p in enumerate(pages)]
    got = template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_template_decides_inside_and_outside_the_article(spark):
    inside = "<html><body><nav>menu {0}</nav><article><h1>Title {0}</h1><p class='ad'>Subscribe now</p><p>story {0}</p><p>Share this</p></article></body></html>"
    assert texts(spark, [inside.format(i) for i in range(5)]) == [f"Title {i} story {i}" for i in range(5)]
    without = "<html><body><div>Our site</div><div><p>story {0}</p><p>Share this</p></div></body></html>"
    assert texts(spark, [without.format(i) for i in range(5)]) == [f"story {i}" for i in range(5)]
    # pages that are all the same have no slots: the elements decide
    assert texts(spark, [inside.format(0)] * 4) == ["Title 0 Subscribe now story 0 Share this"] * 4
    assert texts(spark, [inside.format(0)] * 4 + [inside.format(1)]) == [f"Title {i} story {i}" for i in (0, 0, 0, 0, 1)]


def test_similar_sets_share_a_key_across_band_edges():
    needs = {n: dict(bands_of(n)) for n in range(1, 1300)}
    assert all(need <= block_count(band) for own in needs.values() for band, need in own.items())
    for n in range(1, 1030):
        for m in range(n, 5 * n // 4 + 1):
            common = -(-80 * (n + m) // 180)
            if common <= n:
                bands = needs[n].keys() & needs[m].keys()
                assert any(min(needs[n][b], needs[m][b]) > n + m - 2 * common for b in bands), (n, m)
    rng = np.random.default_rng(5)
    for n, m, times in ((7, 8, 300), (15, 18, 300), (30, 37, 15_000), (31, 38, 15_000), (63, 78, 300), (127, 158, 300), (511, 638, 100)):
        for _ in range(times):
            codes = rng.integers(0, 2**64, m, np.uint64)
            one, other = np.sort(codes[:n]), np.sort(codes)
            assert similar(one, other) and len(np.intersect1d(sketch_keys(one), sketch_keys(other))), (n, m)


def test_class_parts_set_no_wrapper_apart():
    page = "<html><body class='{}'><div class='{}'><nav>menu</nav><p>The story of this page</p><div class='sidebar'>side</div></div></body></html>"
    for name in ("has-sidebar", "no-sidebar", "menu-open", "cookies-accepted", "search-results", "search", "plain"):
        assert template_html.main_text(page.format(name, name), []) == "The story of this page"
    inner = "<body><article><p>Story</p><section class='related-work'>Work</section><section id='social-policy'>Policy</section></article></body>"
    assert template_html.main_text(inner, []) == "Story Work Policy"
