import hashlib
import random

import pytest

from lodestar.llm import html_text, warc

PAGES = "page_id long, url string, html string, archive string, kept long, text string"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", 1, "y") for p, u, h in rows], PAGES)


def test_main_text():
    t = html_text.main_text
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><div id="cookie-banner">Cookies, really</div><header class="top"><a href="/">Home</a></header>
    <nav><ul><li>Menu</li></ul></nav><div class="sidebar"><p>Aside, of all, kinds</p></div><article><header><h1>Head &amp; line</h1></header><p>First, with a comma,   and&nbsp;space.<p>Second<br>half
    <b>bold<p>Third &lt;tag&gt; &#233;</p><ul><li>one<li>two</ul><aside>no</aside><form><p>no</p></form><script>var a = "</p>";</script><!-- no --><div class="comments"><p>Nice, very nice, indeed</p></div></article>
    <div class="ad">Buy, now</div><footer>end</footer></body></html>"""
    assert t(page) == "Head & line\n\nFirst, with a comma, and space.\n\nSecond half bold\n\nThird <tag> é\n\none\n\ntwo"
    assert t(None) == "" and t("") == "" and t("<nav>x</nav>") == "" and t("just text") == "just text"
    assert t("<div><div class=post><h2>T</h2><p>Some, words, here.</p><p>Short</p></div><div class=related><a href=x>Link</a></div></div>") == "T\n\nSome, words, here.\n\nShort"
    assert t("<p>unclosed <a href='x>y") is not None and t("<" * 1000) is not None and t("<p" + " a=\"" * 2000) is not None


def test_extract(spark):
    rows = [(1, "u", "<article><p>a, b</p></article>"), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "x, " * 50_000 + "</p>"), (3, "u", "<p>again</p>")]
    got = html_text.extract(pages(spark, rows)).collect()
    assert sorted((str(g.page_id), g.text) for g in got) == sorted((str(p), html_text.main_text(h)) for p, _, h in rows)
    assert all(g.n_chars == len(g.text) for g in got)
    assert html_text.extract(pages(spark, [])).collect() == []


def captures(spark, rows):
    want, html = {}, {}
    for p, _, h in rows:
        html.setdefault(h or "", []).append(p)
    got = warc.capture_histories(pages(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    for p, u, h in rows:
        b = (h or "").encode()
        known = [x for x in html[h or ""] if x is not None]
        kept = max(known) if len(b) >= 1000 and len(html[h or ""]) > 1 and known else None
        revisit = kept is not None and kept != p
        want.setdefault((p, hashlib.sha1(b).hexdigest(), len(b), "revisit" if revisit else "response", kept if revisit else None, warc.url_key(u)), 0)
        want[(p, hashlib.sha1(b).hexdigest(), len(b), "revisit" if revisit else "response", kept if revisit else None, warc.url_key(u))] += 1
    for g in got:
        want[(g.page_id, g.payload_digest, g.payload_bytes, g.record_type, g.refers_to, g.url_key)] -= 1
    assert not any(want.values())
    keys = [(g.range_no, g.url_key, g.captured_at) for g in sorted(got, key=lambda g: g.range_no)]
    by_range = {}
    for r, k, t in keys:
        by_range.setdefault(r, []).append((k, t))
    last = None
    for r in sorted(by_range):
        assert by_range[r] == sorted(by_range[r])
        assert last is None or last <= by_range[r][0]
        last = by_range[r][-1]


def test_archives_round_trip(spark):
    r = random.Random(1)
    rows = [(k, f"http://www.h{k % 3}.org/{k % 7}?b=2&a=1#f", f"<p>{k % 40}</p>" * (200 if k % 2 else 3)) for k in range(300)]
    rows += [(None, None, None), (None, "http://x.org/é \n", "<p>é\r\n\r\n</p>" * 200), (5, "u", "same"), (5, "u", "same"), (7, "not a url [", "x" * 999), (8, "", "x" * 999), (9, "a", "y" * 1000), (10, "a", "y" * 1000), (11, "a", "z" * 300_000)]
    r.shuffle(rows)
    captures(spark, rows)


def test_no_pages(spark):
    assert warc.capture_histories(pages(spark, [])).collect() == []


def test_many_runs_merge_in_passes(spark):
    path = warc.scratch(spark, "t")
    rows = [(k, f"http://h{k % 11}.org/{k * 7919 % 101}", f"p{k}") for k in range(400)]
    names = warc.write_archives(pages(spark, rows).repartition(9), path)
    got = warc.capture_index(spark, path, names, fan_in=2, per_range=50).orderBy("range_no").collect()
    assert len(got) == 400


def test_loser_tree():
    r = random.Random(2)
    for k in range(9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for run in runs for x in run)


def test_names_do_not_empty_a_page():
    t, body = html_text.main_text, "<p>The first, quite ordinary, sentence of it.</p><p>And another one, which follows.</p>"
    want = "The first, quite ordinary, sentence of it.\n\nAnd another one, which follows."
    for open_, close in (
        ('<div class="site-content no-sidebar">', "</div>"), ('<article class="post has-sidebar">', "</article>"), ('<div class="social science">', "</div>"),
        ('<form id="aspnetForm"><div class="content-sidebar">', "</div></form>"), ('<div class="content"><section id="related-work">', "</section></div>"), ('<body class="login"><div class="promo">', "</div>"),
    ):
        assert t(f"<html>{open_}{body}{close}</html>") == want, open_
    assert t(f'<div class="left-sidebar">{body}</div><article>{"<p>" + "Long enough, " * 9 + "</p>"}</article>') == ("Long enough, " * 9).strip()
    for name in ("cookie-banner", "ad", "adSlot1", "comments-section", "related", "share-buttons", "widget-area", "newsletter signup"):
        assert t(f'<div id="main-text">{body}</div><div class="{name}"><p>Something else, and more of it.</p></div>') == want, name


def test_text_divided_over_siblings_is_whole():
    parts = ["An introduction of one ordinary paragraph that says, in some words, what the longer text below is going to be about."] + ["A paragraph, with commas, and more commas, that goes on for quite some time without end, " * 3] * 3
    page = f"<body><div class=a><p>{parts[0]}</p></div><div class=b>" + "".join(f"<p>{p}</p>" for p in parts[1:]) + "</div><div class=c><a href=x>Some links</a> <a href=y>only, nothing else</a></div></body>"
    assert html_text.main_text(page) == "\n\n".join(p.strip() for p in parts)


def test_awkward_pages_take_linear_time():
    import time

    start, n, t = time.time(), 100_000, html_text.main_text
    for tag in ("div", "font", "b", "ul><li", "p", "table><tr><td", "article", "form"):
        assert "deep, text" in t(f"<{tag}>" * n + "deep, text")
    assert t("<b><div>" + "<font></b>" * n + "x") == "x"
    assert t("<script>var a = '</p>';</script>" * 20_000 + "<p>x, y</p>") == "x, y"
    assert t("İ" * 60 + "<p>before, it</p><script>a < b</script><p>after, it</p>").endswith("before, it\n\nafter, it")
    assert t("<script>if (a<b && c) {}</script><p>kept, too</p>") == "kept, too"
    assert t("<p>a &#65; &#0000000065; &#" + "9" * n + "; b</p>") == "a A A � b"
    for odd in ("<p a=\"x", "<p a='\">", "<", "<!-", "</", "&", "<a b=\"'", "<x y z='"):
        t(odd * n + ">text")
    t("<p " + "a=b " * n + ">x</p>" + " " * 1_000_000 + "<p>" + ", " * 500_000)
    assert time.time() - start < 60


def test_scores_against_a_plain_recursion():
    r = random.Random(3)

    def build(depth):
        if depth == 0 or r.random() < 0.2:
            return "words, " * r.randrange(1, 40)
        tag = r.choice(["div", "section", "p", "span", "a", "b", "td", "article"])
        inner = "".join(build(depth - 1) for _ in range(r.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag}>" if tag != "p" else f"<p>{'text, ' * r.randrange(20)}</p>"

    def lengths(node, linked):
        linked, total, in_links = linked or node.tag == "a", 0, 0
        for x in node.items:
            n, k = (len(x.strip()), len(x.strip()) * linked) if isinstance(x, str) else lengths(x, linked)
            total, in_links = total + n, in_links + k
        assert (node.length, node.linked) == (total, in_links)
        return total, in_links

    def blocks(node):
        """(text, block element) by recursion."""
        out, run = [], []

        def end(at):
            text = " ".join("".join(run).split())
            run.clear()
            while at.tag not in html_text.BLOCK and at.parent is not None:
                at = at.parent
            if text:
                out.append((text, at))

        def walk(at):
            for x in at.items:
                if isinstance(x, str):
                    run.append(x)
                elif x.tag in html_text.BLOCK:
                    end(at)
                    walk(x)
                    end(x)
                else:
                    walk(x)

        walk(node)
        end(node)
        return out

    def scores(node, every):
        """Each element's points from the blocks at most four steps below where they start."""
        got = 0.0
        for text, at in every:
            at = at.parent if at.tag in ("p", "td", "li") else at
            for share in (1, 2, 6, 9, 12):
                if at is node:
                    got += (1 + text.count(",") + min(len(text) / 100, 3)) / share
                at = at.parent if at is not None else None
        return got

    for _ in range(200):
        root, nodes = html_text.parse("".join(build(6) for _ in range(3)))
        html_text.measure(nodes)
        lengths(root, False)
        every = html_text.blocks_of(root)
        assert every == blocks(root)
        html_text.score_containers(every)
        for node in nodes[1:]:
            assert abs(node.score - scores(node, every)) < 1e-6


PARAGRAPHS = "<p>The first paragraph of the text has many words, some commas, and goes on for a while so that it is long enough to be one.</p><p>The second follows, with other words, and it also goes on for long enough to count as one of its own.</p>"
COMMENTS = '<div class="c"><b>Ann</b><p>JUNK I think that this is a very good text, and I have liked to read it a lot, thank you so much for it all.</p></div><div class="c"><b>Bob</b><p>JUNK no, I do not agree with it, as there are many things, and reasons, that speak against it in my own opinion.</p></div>'


def page_of(inside: str, after: str = "") -> str:
    return f"<html><body><header><a href=/>Home</a></header><main><article><h1>Title</h1>{PARAGRAPHS}{inside}{PARAGRAPHS}</article>{after}</main><footer>foot</footer></body></html>"


@pytest.mark.parametrize("name", "google-ad ad-banner-728x90 adsbygoogle taboola outbrain newsletter-cta blog-sidebar related-articles privacy-notice cookie-policy-notice post-navigation share-this mega-promo partner-ad".split())
def test_adverts_and_notices_leave_the_article(name):
    plain = html_text.main_text(page_of(""))
    part = f'<div class="{name}">JUNK buy this thing now</div>'
    assert html_text.main_text(page_of(part)) == plain == html_text.main_text(page_of("", part))


@pytest.mark.parametrize("name", "post-comments article-comments blog-comments entry-comments wp-comments story-comments reader-comments-list visitor-comments discussion".split())
def test_readers_comments_leave_the_article(name):
    plain = html_text.main_text(page_of(""))
    for kind in ("class", "id"):
        part = f'<div {kind}="{name}">{COMMENTS}</div>'
        assert html_text.main_text(page_of(part)) == plain == html_text.main_text(page_of("", part))


@pytest.mark.parametrize("name", "discussion author-comments-on-method related-work notice-of-the-kings share-prices-in-1929 sidebar-effects comments-on-kant".split())
def test_a_text_named_like_a_part_stays(name):
    assert html_text.main_text(page_of(f'<div class="{name}">{PARAGRAPHS.replace("The", "KEPT the")}</div>')).count("KEPT") == 2


def test_formulas_and_labels_outside_forms_stay():
    text = html_text.main_text(page_of("<p>where <math><mi>x</mi></math> holds, and <label>this label</label> stays in the text of the page.</p><form><label>Your name</label><input></form>"))
    assert "where x holds, and this label stays" in text and "Your name" not in text
