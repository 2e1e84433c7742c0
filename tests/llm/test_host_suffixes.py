import random

import numpy as np
import pytest

from claimsift.llm import host_suffixes as hs

PAGES = "page_id long, url string, html string, text string, key long, host string, blocks string"


def page(k, url, text):
    return (k, url, text, "t", 5, "h", "b")


@pytest.mark.parametrize("text,inside,outside", [
    ("<nav>menu</nav><header>H</header><article class='x'><header><h1>T &amp; t</h1></header><p>a <b>b<br>c<p>d&nbsp;&#233;</b><div class=\"ad\">AD</div>"
     "<aside>s</aside><section id=comments><article><p>hi</p></article></section><ul><li>x<li>y</ul><script>var t='</p>';</script>tail</article><footer>f</footer>",
     ["T & t", "a b c", "d é", "x", "y", "tail"], []),
    ("plain < text <!-- never closed", [], ["plain < text"]),
    ("", [], []),
    ("<main><p>one</p><form><input>q</form></main><p>two</p>", ["one"], ["two"]),
    ("<div>a</div><div hidden>b</div><div class='cookie-notice'>c</div><p>d<table><tr><td>e<td>f</table>", [], ["a", "d", "e f"]),
    ("<style>p{}</style><article>never closed <p>but read", ["never closed", "but read"], []),
    ("<ARTICLE>\n a\t\n b </ARTICLE><div>c", ["a b"], ["c"]),
])
def test_blocks(text, inside, outside):
    assert hs.blocks(text) == (bool(inside), inside, outside)


@pytest.mark.parametrize("shard_words", [1 << 18, 300])
def test_repeats_between_pages_of_a_host_go(spark, shard_words):
    rng = random.Random(1)
    words = lambda n: " ".join(f"{rng.choice('abcdefghijkl')}{rng.randrange(999)}" for _ in range(n))
    menu, end, body = words(20), words(15), {k: words(60) for k in range(40)}
    rows = [page(k, f"http://h.com/{k}", f"<body><div>{menu}</div><div>{body[k]}</div><div>{end}</div>") for k in range(40)]
    body[40], body[41], body[42] = body[3], f"{menu}\nalone", body[3]
    rows += [page(40, "http://h.com/40", rows[3][2]), page(41, "https://other.org", f"<div>{menu}</div>alone"), page(42, "http://h.com/42", f"<article>{body[3]}</article>")]
    got = hs.extract(spark.createDataFrame(rows, PAGES), shard_words=shard_words).collect()
    assert {r.page_id: r.text for r in got} == body and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [page(None, None, None), page(1, "x", ""), page(1, "x", ""), page(2, None, "<article>" + "long <b>" * 50_000 + "</article>"), page(3, "http://a", "<article>é😀</article>")]
    got = hs.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 5 * 50_000 - 1), ("3", 2), ("None", 0)]
    assert hs.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_repeated_equals_a_naive_search(seed):
    rng = random.Random(seed)
    streams = [[rng.choice("abc") for _ in range(rng.choice([0, 2, 3, 9, 30]))] for _ in range(12)]
    pages = np.array([rng.randrange(6) for _ in streams])
    owner, place, group, repeats = hs.repeated(streams, pages, 4)
    on: dict = {}
    for stream, page_number in zip(streams, pages, strict=True):
        for k in range(len(stream) - 3):
            on.setdefault(tuple(stream[k:k + 4]), set()).add(page_number)
    got = {(o, p): (g, r) for o, p, g, r in zip(owner.tolist(), place.tolist(), group.tolist(), repeats.tolist(), strict=True)}
    want = {(o, k): tuple(s[k:k + 4]) for o, s in enumerate(streams) for k in range(len(s) - 3)}
    assert got.keys() == want.keys() and all(got[at][1] == (len(on[want[at]]) > 1) for at in want)
    assert len({(got[at][0], want[at]) for at in want}) == len(on) == len({got[at][0] for at in want})


def naive(rows, long=hs.LONG):
    """Text of every row by direct search over the words in doubt of a host's distinct pages."""
    parsed = {r[0]: (r[1].split("/")[2], *hs.marked(r[2])) for r in rows}
    streams = {k: [w for text, doubt in found if doubt for w in text.split(" ")] for k, (_, _, found) in parsed.items()}
    content = {k: " ".join(text for text, _ in found) for k, (_, _, found) in parsed.items()}
    on, shorts, texts = {}, {}, {}
    for k, (host, has, found) in parsed.items():
        for at in range(len(streams[k]) - long + 1):
            on.setdefault((host, *streams[k][at:at + long]), set()).add(content[k])
        for text, doubt in found:
            if has and doubt and len(text.split(" ")) < long:
                shorts.setdefault((host, text), set()).add(content[k])
    for k, (host, has, found) in parsed.items():
        hit = [False] * len(streams[k])
        for at in range(len(hit) - long + 1):
            if len(on[(host, *streams[k][at:at + long])]) > 1:
                hit[at:at + long] = [True] * long
        at, kept = 0, []
        for text, doubt in found:
            left = text.split(" ")
            if doubt:
                at += len(left)
                left = [w for w, gone in zip(left, hit[at - len(left):at], strict=True) if not gone]
            if left and not (doubt and has and len(shorts.get((host, text), [])) > 1):
                kept.append(" ".join(left))
        texts[k] = "\n".join(kept)
    return texts


@pytest.mark.parametrize("shard_words", [1 << 18, 110])
def test_outcome_does_not_depend_on_shards(spark, shard_words):
    rng = random.Random(3)
    words = lambda n: " ".join(f"{rng.choice('abcdefghijkl')}{rng.randrange(999)}" for _ in range(n))
    stock, crumb, rows = words(14), words(3), []
    for k in range(12):  # the same boilerplate twice on each page
        rows.append((k, f"http://h.com/{k}", f"<div>{stock}</div><p>{words(30)}</p><div>{stock}</div>"))
    rows.append((12, "http://h.com/12", rows[0][2].replace("</div><p>", " ").replace("</p><div>", " ")))  # other blocks, same words
    for k in range(13, 25):  # beside an article: unique text stays, what repeats goes, however short
        rows.append((k, f"http://h.com/{k}", f"<div>{crumb}</div><p>{words(5)}</p><article><p>{words(20)}</p></article><div>{stock} {words(2)}</div><div>{stock}</div>"))
    rows += [(25, "http://g.com/1", rows[14][2]), (26, "http://g.com/2", rows[14][2])]  # copies are one page
    want = naive(rows)
    assert stock not in "".join(want[k] for k in range(25)) and stock in want[25] and crumb not in want[13] and crumb in want[26]
    got = hs.extract(spark.createDataFrame([page(*r) for r in rows], PAGES).repartition(3), shard_words=shard_words).collect()
    assert {r.page_id: r.text for r in got} == want


def test_names_inside_an_article_that_only_resemble_widgets(spark):
    keep = "<h2 id='related-work'>Related work</h2><p class='notice-period'>Two weeks.</p><section id='search'><p>How to search.</p></section>"
    drop = "<div class='ad'>AD</div><div class='share-buttons'>S</div><div class='box newsletter-box'>N</div><section id='comments'>c</section><div role='search'>q</div>"
    share = "<div id='share-{0}'>" + " ".join(f"w{k}" for k in range(20)) + "</div>"  # resembles one, and repeats
    rows = [page(k, f"http://h/{k}", f"<article><h1>T{k}</h1>{keep}{drop}{share.format(k)}<p>End {k}.</p></article>") for k in (1, 2)]
    rows += [page(3, "http://other/3", f"<article><h1>T3</h1>{keep}{drop}<p>End 3.</p></article><p>Unique outside.</p>")]
    got = {r.page_id: r.text for r in hs.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "T3\nRelated work\nTwo weeks.\nHow to search.\nEnd 3.\nUnique outside."
    assert "w5" not in got[1] + got[2] and got[1].startswith("T1") and got[1].endswith("End 1.")
