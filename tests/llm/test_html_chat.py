"""Operators 3 and 7 against plain versions, and on odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb

from skyquarry.llm import chat, html, oracle

PAGES = {
    "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b>three<br>four &amp; f&eacute;&#8364;&nbsp;x<p>five</article><footer>f</footer></body>": "Head One twothree four & fé€ x five",
    "<article><div class='ad big'>buy</div><p>text</p><aside>side</aside><form>f <input> g</form><div id=comments><p>c</div><script>var a='</p><p>';</script>end": "text end",
    "<div class=sidebar>x</div><p>no article</p><div role=navigation>y</div>tail": "no article tail",
    "a < b and <!-- <p>hidden</p> --> c <![CDATA[x]]> d<!-- open": "a < b and c d",
    "<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre> x\n  y </pre></article>outside": "one two a b c x y",
    "": "", "<style>p{}</style>": "", "plain": "plain", "<article><p style='display: none'>no<p>yes<span hidden>no</span>&copy &notanentity; &am</article>": "yes© ¬anentity; &am",
    "<ARTICLE><P CLASS=\"Cookie-Notice\">c</P><p title='a>b'>d</p></ARTICLE>": "d", "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>": "deep",
    "<p>" + "word " * 200_000: ("word " * 200_000).strip(), "<" * 5000: "<" * 5000,
}


def test_pages(spark):
    rows = [(i, f"http://h{i}.org/", h, "clash") for i, h in enumerate(PAGES)] + [(900, None, None, "clash"), (901, None, "<p>x", "clash"), (901, None, "<p>x", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html.extracted(pages).collect())
    want = [(i, t, len(t)) for i, t in enumerate(PAGES.values())] + [(900, "", 0), (901, "x", 1), (901, "x", 1)]
    for got, expect in zip(found, want):
        assert got == expect
    assert html.extracted(pages.limit(0)).collect() == []


def test_real_pages_keep_the_whole_article(spark):
    import html as std

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    texts = {r.page_id: r.text for r in html.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")])
        assert texts[r.page_id] == " ".join(std.unescape(re.sub("<[^>]+>", " ", inner)).split())


def test_boilerplate_of_a_host(spark):
    share = "Please share this lovely page with all of your many friends today"
    rows = []
    for i in range(600):
        body = " ".join(f"w{(i * 7919 + j * 31) % 100_003}" for j in range(60))
        rows.append((i, "http://one.org/%d" % i, f"<div>{body}</div><p>{share}</p>" if i % 2 else f"<article><p>{body}</p><p>{share}</p></article>"))
    rows += [(1000 + i, "http://copies.org/%d" % i, "<article><p>the very same article on every page of the host, word for word</p></article>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.extracted(pages).collect():
        assert ("lovely" in r.text) is False and r.text, r
        assert r.page_id < 1000 or "very same" in r.text


def test_boilerplate_that_outweighs_the_article(spark):
    """Unmarked pages: a menu and a footer longer than the article go, near copies of an article stay."""
    words = lambda key, n: " ".join(f"{key}{j}" for j in range(n))
    menu, foot = words("menu", 60), words("foot", 40)
    page = lambda *own: "".join(f"<div>{b}</div>" for b in (menu, *own, foot))
    rows = [(i, f"http://heavy.org/{i}", page(words(f"own{i}x", 20))) for i in range(40)]
    rows += [(100 + i, f"http://heavy.org/{i}", page(words("copied", 50), words("again", 50), words(f"edit{i}x", 10))) for i in range(15)]
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert found[i] == words(f"own{i}x", 20)
    for i in range(15):
        assert found[100 + i] == " ".join((words("copied", 50), words("again", 50), words(f"edit{i}x", 10)))


def plain_kept(pages, run, of=None):
    """(text, covered tokens) of each page of one host, from sets of runs; ``of``: the page that each counts as."""
    of = of if of is not None else html.families([[t for t, _ in p] for p in pages]).tolist()
    on, distinct = defaultdict(set), len(set(of))
    streams = [[(t, b, k) for b, (x, k) in enumerate(p) for t in x.split(" ")] for p in pages]
    for i, s in enumerate(streams):
        for a in range(len(s) - run + 1):
            on[tuple(t for t, _, _ in s[a : a + run])].add(of[i])
    out = []
    for p, s in zip(pages, streams):
        covered = set()
        for a in range(len(s) - run + 1):
            n = len(on[tuple(t for t, _, _ in s[a : a + run])])
            for j in range(a, a + run):
                share, least = (html.SHARE_INSIDE, html.LEAST_INSIDE) if s[j][2] == html.INSIDE else (html.SHARE_OUTSIDE, html.LEAST_OUTSIDE)
                if n > max(distinct * share, least - 1):
                    covered.add(j)
        want = html.INSIDE if any(k == html.INSIDE for _, k in p) else html.OPEN
        mine = [(a, t) for a, (t, _, k) in enumerate(s) if k == want]
        out.append((" ".join([t for a, t in mine if a not in covered] or [t for _, t in mine]), len(covered)))
    return out


def test_suffix_array():
    import numpy as np

    rng = random.Random(1)
    for n in (1, 2, 3, 40):
        for _ in range(60):
            pages = [[rng.randrange(n) for _ in range(rng.randrange(14))] for _ in range(rng.randrange(1, 6))]
            suffixes = [tuple(p[i:]) for p in pages for i in range(len(p))]
            left = np.array([len(x) for x in suffixes], dtype=np.int64)
            order, shared = html.suffix_array(np.array([x[0] for x in suffixes], dtype=np.uint64), left)
            assert [suffixes[i] for i in order] == sorted(suffixes)
            for x, y, k in zip(order, order[1:], shared[1:]):
                x, y = suffixes[x], suffixes[y]
                assert x[:k] == y[:k] and (k == min(len(x), len(y)) or x[k] != y[k])


def _host(rng, lines, n):
    kinds = (html.OPEN, html.INSIDE, html.MARKED)
    return [[(rng.choice(lines) if rng.random() < 0.4 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))), rng.choice(kinds)) for _ in range(rng.randrange(6))] for _ in range(n)]


def test_runs_match_a_plain_search(monkeypatch):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(4, 20))) for _ in range(8)]
    monkeypatch.setattr(html, "LEAST_INSIDE", 4)
    for _ in range(40):
        pages = _host(rng, lines, rng.randrange(14))
        stream = html.Stream(pages)
        texts, covered = stream.kept(stream.repeated(), stream.distinct)
        assert list(zip(texts, covered)) == plain_kept(pages, html.RUN)


def test_chunks_of_a_host_count_as_one(spark, monkeypatch):
    """The same texts with one array and with many, and those that plain counting over the whole host gives."""
    rng = random.Random(6)
    lines = [" ".join(f"{rng.choice('abc')}{rng.randrange(30)}" for _ in range(rng.randrange(10, 20))) for _ in range(40)]
    tag = {html.OPEN: "<div>{}</div>", html.INSIDE: "<article>{}</article>", html.MARKED: "<nav>{}</nav>"}
    weights = [1 / (i + 1) ** 1.2 for i in range(40)]
    pages = [[(x if rng.random() > 0.6 else rng.choices(lines, weights)[0], k) for x, k in p] for p in _host(rng, lines, 700)]
    pages = [p + [(f"own{i} " * 3 + f"page{i}", html.OPEN)] for i, p in enumerate(pages)]
    rows = [(i, "http://big.org/", "".join(tag[k].format(t) for t, k in p)) for i, p in enumerate(pages)] + [(9000 + i, "http://small.org/", "<p>x") for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    parsed = [html.blocks(r[2]) for r in rows[: len(pages)]]
    whole = sorted(map(tuple, html.extracted(frame).collect()))
    assert [(r[2], r[4]) for r in whole[: len(pages)]] == plain_kept(parsed, html.RUN)
    monkeypatch.setattr(html, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(html, "SHARE_OUTSIDE", 0.05)
    many = sorted(map(tuple, html.extracted(frame).collect()))
    assert [(r[2], r[4]) for r in many[: len(pages)]] == plain_kept(parsed, html.RUN)
    assert any(r[4] for r in many) and many != whole


def test_long_pages_are_read_in_one_pass():
    import time

    for page in ("<i><br>" * 150_000, "<b>" * 200_000, "<p>a" * 200_000, "<a" * 300_000, "<div><p>" * 60_000 + "</p></div>" * 60_000, "<!--" * 200_000, "<td x='" * 100_000):
        began = time.perf_counter()
        html.blocks(page)
        assert time.perf_counter() - began < 5, page[:8]


def test_the_array_removes_blocks_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = html.extracted(pages)
    assert found.filter("n_repeated > 0").count() > 500


TURNS = "conv_id long, turn long, role string, text string, turns string"


def conv(c, *turns):
    return [(c, i, r, t, "clash") for i, (r, t) in enumerate(turns)]


def test_preference_pairs(spark):
    u, a = "user", "assistant"
    rows = conv(1, (u, "hi"), (a, "well hello there"), (u, "x")) + conv(2, (u, "hi"), (a, "yo")) + conv(3, (u, "alone")) + conv(4, (None, None)) + conv(None, (u, "nobody"), (a, "é😀"))
    rows += conv(5, (u, "q"), (a, "same"), (u, "more"), (a, "good long answer")) + conv(6, (u, "q"), (a, "same"), (u, "more"), (a, "bad")) + conv(7, (u, "eq"), (a, "t")) * 2 + conv(8, (u, "eq"), (a, "t"))
    turns = spark.createDataFrame(rows, TURNS)
    found = {r.chosen_id: r for r in chat.formatted(chat.paired(turns)).collect()}
    assert set(found) == {1, 3, 4, None, 5, 7}
    r = found[1]
    assert (r.rejected_id, r.prompt, r.chosen, r.rejected, r.usable) == (2, "<|user|>\nhi<|end|>\n", "<|assistant|>\nwell hello there<|end|>\n<|user|>\nx<|end|>\n", "<|assistant|>\nyo<|end|>\n", True)
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["well hello there"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["yo"]
    assert (found[5].rejected_id, found[5].prompt_turns, found[5].chosen) == (6, 3, "<|assistant|>\ngood long answer<|end|>\n")
    assert (found[7].rejected_id, found[7].usable, found[7].prompt_turns) == (8, False, 1)
    assert found[3].rejected_id is None and found[3].rejected is None and not found[3].made
    # a made side: of one word there are bad, t, yo and é😀, in the order of their digests
    after = dict(zip(ring := sorted(["bad", "t", "yo", "é😀"], key=lambda x: hashlib.md5(x.encode()).hexdigest()), [*ring[1:], "well hello there"]))["é😀"]
    r = found[None]
    assert (r.rejected_id, r.made, r.usable, r.prompt, r.chosen, r.rejected) == (None, True, True, "<|user|>\nnobody<|end|>\n", "<|assistant|>\né😀<|end|>\n", f"<|assistant|>\n{after}<|end|>\n")
    assert chat.formatted(chat.paired(turns.limit(0))).collect() == []


def test_every_conversation_is_in_one_row(spark):
    rows = [t for c in range(500) for t in conv(c, ("user", "hot" if c % 3 else f"q{c}"), ("assistant", f"a{c % 5}"), ("user", f"{c}"))]
    import unittest.mock as m

    with m.patch.object(chat, "BLOCK", 50):
        pairs = chat.paired(spark.createDataFrame(rows, TURNS)).collect()
    ids = [i for r in pairs for i in (r.chosen_id, r.rejected_id) if i is not None]
    assert sorted(ids) == list(range(500))
    for r in pairs:
        if r.rejected_id is not None:
            assert r.chosen[0].text == r.rejected[0].text


def test_a_hot_first_turn_loses_no_pair(spark):
    """More different answers to one prompt than go to one range: one conversation at most stays alone."""
    rows = [t for c in range(301) for t in conv(c, ("user", "hot"), ("assistant", f"answer {c}"))]
    rows += [t for c in range(400, 600) for t in conv(c, ("user", "deep"), ("assistant", "same"), ("user", f"q{c // 2}"), ("assistant", f"a{c}"))]
    pairs = chat.formatted(chat.paired(spark.createDataFrame(rows, TURNS))).collect()
    hot, deep = [r for r in pairs if r.chosen_id < 400], [r for r in pairs if r.chosen_id >= 400]
    assert (len(hot), sum(r.usable for r in hot), sum(r.rejected_id is None for r in hot), sum(r.made for r in hot)) == (151, 151, 1, 1)
    assert len(deep) == 100 and all(r.prompt_turns == 3 and r.usable for r in deep)


def test_against_sql(spark, tmp_path):
    """Few first turns, shared replies, ties, nulls, empty conversations and a reply that most end with."""
    rng = random.Random(4)
    rows = []
    for c in range(400):
        turns = [("system", "be brief")] if rng.random() < 0.2 else []
        for _ in range(rng.randrange(4)):
            turns += [("user", rng.choice(["hi", "why?", f"q{rng.randrange(40)}", None])), ("assistant", rng.choice(["sorry, I can't", "sorry, I can't", f"é{rng.randrange(9)} \U0001f600 ok", "", f"a b {rng.randrange(200)}"]))]
        rows += conv(c, *turns, *[("user", "thanks")] * rng.randrange(2))
    rows += [(r[0], r[1], r[2], "tie", "") for r in rng.sample(rows, 40)] + rng.sample(rows, 40) + [(7, None, "user", "no turn", ""), (None, 0, "user", "no id", ""), (None, 1, "assistant", "none", "")]
    rows += conv(900, ("user", "long"), ("assistant", "word " * 100_000), ("assistant", "x" * 300_000))
    turns = spark.createDataFrame(rows, TURNS)
    for n, part in enumerate((turns, turns.filter("conv_id = 3"), turns.limit(0), turns.filter("role = 'user'"))):
        part.drop("turns").write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/{n}/conversations.parquet/*.parquet'")
        said = con.sql(oracle.CHAT)
        ours = chat.op7(spark, f"{tmp_path}/{n}").select(*said.columns).collect()
        assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, said.fetchall()))
    assert chat.formatted(chat.paired(turns)).filter("made").count() > 5
