import itertools
import math
import random

import pytest

from estatelens.llm import pages

PARAGRAPHS = ["The harbour lay quiet that morning, and the boats had not yet left for the banks.", "Short one.", "By noon the wind had turned to the north & the first sails stood out to sea, one after the other.", "Nobody on the quay spoke of it until the evening."]
LONG_COMMENT = "I was there that day, and I can only say that it was just as the author tells it, every word of it."
WHOLE = "\n\n".join(["A day at sea", *PARAGRAPHS])
P = "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in PARAGRAPHS)
BODY = f"<h1>A day at sea</h1>{P}"
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li></ul>"
AROUND = {
    "semantic": "<header><a href='/'>The Harbour Post</a></header><nav>{m}</nav><main><article>{b}</article></main><aside><h2>Popular</h2>{m}</aside><footer><p>&copy; 2024 The Harbour Post. All rights reserved.</p></footer>",
    "article only": "<nav>{m}</nav><div class='ad'>Buy one, get one free this week only.</div><article>{b}</article><footer>&copy; x</footer>",
    "classes": "<div class='site-header'>The Harbour Post</div><div id='main-menu'>{m}</div><div class='post-content'>{b}</div><div class='sidebar'><p>A long line about something else that is not part of the text.</p></div><div id='footer'>Imprint</div>",
    "ad within": "<article><h1>A day at sea</h1>{first}<div class='advert'>Our boats are the best boats that you can buy anywhere, so come and buy one today.</div>{rest}</article>",
    "comments within": "<article>{b}<section class='comments'><h2>2 comments</h2><p>{c}</p><p>{c}</p></section></article>",
    "comments as articles": "<article>{b}<article><p>{c}</p></article></article>",
    "comments by heading": "<article>{b}<section><h3>Comments (2)</h3><p>{c}</p><p>{c}</p></section></article>",
    "form and notice": "<div class='cookie-notice'><p>We use cookies to make this site work better for you. <button>OK</button></p></div><form action='/s'><label>Search</label><input name=q></form><article>{b}<form><p>Leave us your address and we will write to you every week.</p><input></form></article>",
    "scripts": "<script>document.write('<p>not this</p>')</script><style>p{{}}</style><!-- <p>nor this</p> --><noscript><p>Please turn on scripts to read this site.</p></noscript><article>{b}</article><script>var a='</p>';</script>",
    "page in a form": "<form id='aspnet'><div class='topbar'>{m}</div><article>{b}</article></form>",
    "teaser aside": "<main><article>{b}</article><aside><article><h2>Other</h2><p>A teaser for another story, which is not part of this one.</p></article></aside></main>",
    "open elements": "<nav>{m}</nav><article><h1>A day at sea{open}</article><footer>&copy; 2024",
    "no hints": "<div>{m}</div><div><div>{b}</div></div><div><a href='/i'>Imprint</a> <a href='/p'>Privacy</a></div>",
    "roles": "<div role='banner'>The Harbour Post</div><div role='navigation'>{m}</div><div role='main'>{b}</div><div role='contentinfo'>All rights reserved by the owners of this site.</div>",
    "has sidebar": "<div class='content has-sidebar'>{b}</div><div class='widget-area'><div class='widget'>Tags</div></div>",
}


@pytest.mark.parametrize("name", AROUND)
@pytest.mark.parametrize("lang", ["", "<!DOCTYPE html><html><head><title>A day</title></head><body class='has-sidebar nav-open'>"])
def test_article_of_planted_pages(name, lang):
    first, rest = P.split("</p>", 1)
    page = AROUND[name].format(b=BODY, m=MENU, c=LONG_COMMENT, first=first + "</p>", rest=rest, open=P.replace("</p>", ""))
    assert pages.main_text(lang + page, pages.PRIOR.tolist()) == WHOLE


def test_text_of_blocks():
    read = lambda s: pages.main_text(f"<article>{s}</article>", pages.PRIOR.tolist())
    assert read("<p>a <b>b</b>\n\t c&nbsp;d&#33;<br>e</p>") == "a b c d! e"
    assert read("<p><b>one<br><p>two</p>") == "one\n\ntwo"
    assert read("<p>5 < 6 &amp;&lt;p&gt; &unknown; &am</p>") == "5 < 6 &<p> &unknown; &am"
    assert read("<ul><li>one<li>two</ul><table><tr><td>3<td>4</table>loose <i>text</i><div>in</div>after") == "one\n\ntwo\n\n3\n\n4\n\nloose text\n\nin\n\nafter"
    assert read("<p title='a > b' class=x>in</p><p data-x=\"'\">it</p>") == "in\n\nit"
    assert [pages.main_text(s, pages.PRIOR.tolist()) for s in (None, "", "  ", "<article></article>", "<nav>Home</nav>", "<article><p>cut <a hre", "<article>x<!-- cut", "<article>x<script>var y")] == ["", "", "", "", "", "cut", "x", "x"]
    deep = "<div>" * 5000 + "<p>deep down</p>"
    assert read(deep) == "deep down"
    assert len(read("<p>many words here, and one more.</p>" * 20_000).split("\n\n")) == 20_000


def cost(gain, edges, label):
    return sum(w for a, b, w in edges if label[a] != label[b]) - sum(g for g, c in zip(gain, label, strict=True) if c)


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(3)
    through_flow = 0
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(cost(gain, edges, x) for x in itertools.product([False, True], repeat=n))
        least = [x for x in itertools.product([False, True], repeat=n) if cost(gain, edges, x) == best]
        got = pages.minimum_cut(gain, edges)
        assert cost(gain, edges, got) == best and sum(got) == max(map(sum, least))
        flow = pages.Flow(gain, edges).content()
        through_flow += flow == got
    assert through_flow == 300


def test_long_undecided_chain():
    n = 3000
    gain = [1 if i % 2 else -1 for i in range(n)]
    edges = [(i, i + 1, 5) for i in range(n - 1)]
    assert all(pages.minimum_cut(gain, edges))


def test_classifier_learns_from_elements(spark):
    good = "<article>" + "<p>word word word</p>" * 5 + "</article><footer>" + "<p>A line that is long enough to be taken for a part of the text, were it not for this site.</p>" * 3 + "</footer>"
    df = spark.createDataFrame([(i, f"u{i}", good) for i in range(30)] * 2, "page_id bigint, url string, html string")
    weights = pages.learn(df)
    assert weights == pages.learn(df.distinct()) and weights != pages.PRIOR.tolist()
    assert weights[1] > pages.PRIOR[1] and weights[4] < pages.PRIOR[4]
    bare = spark.createDataFrame([(1, "u", "<p>x</p>")], df.schema)
    assert pages.learn(bare) == pages.PRIOR.tolist() == pages.learn(df.limit(0))
    assert pages.fit([(0, 0, 0, 0, True, 5)]) == pages.PRIOR.tolist()
    few = [(1, 0, 0, 0, True, 5), (4, 0, 1, 0, False, 3)]
    w = pages.fit(few)
    x = [[w[o + r[j]] for j, o in enumerate(pages.OFFSETS)] for r in few]
    p = [1 / (1 + math.exp(-sum(v))) for v in x]
    assert abs(w[1] - pages.PRIOR[1] - 200 * (1 - p[0])) < 0.01 and abs(w[4] - pages.PRIOR[4] + 200 * p[1]) < 0.01  # where the gradient is 0


def test_awkward_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>"), (1, "u", f"<article>{BODY}</article>"), (None, None, None), (2, None, ""), (None, "v", "<p>" + "far " * 200_000 + ".</p>"), (3, "w", "<nav>Home</nav>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = pages.page_texts(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "", 0), (0, "v", 800_001), (1, "u", len(WHOLE)), (1, "u", len(WHOLE)), (2, "", 0), (3, "w", 0)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.page_texts(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS text", "'x' AS n_chars", "5 AS words", "6 AS `a.b`", "7 AS content")
    assert pages.page_texts(clash).count() == 6
    kept = pages.extract_text(clash, pages.learn(clash))
    assert kept.columns == ["page_id", "url", "words", "a.b", "content", "text", "n_chars"]
    assert kept.filter("url = 'u'").first().text == WHOLE and kept.filter("`a.b` = 6").count() == 6
