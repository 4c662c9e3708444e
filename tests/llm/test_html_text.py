import random

from tallyloom.llm.html_text import extract_main_text, main_text, read

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a><li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div>
<div class="page-with-sidebar"><article><header><h1>{title}</h1></header><p>{first}<br>next &amp; &lt;x&gt; &eacute;<p>a<b>b</b>c
  <em>d</em></p><form><input name=q><label>Search</label></form><ul><li>one<li>two</ul><div class="ad">Buy</div>
<section id="comments"><p>Nice post</p></section></article>
<aside>Side</aside></div><footer>&copy; host</footer></body></html>"""


def text(page, *rest):
    return " ".join(t for _, t in main_text(page, *(rest or (set(), None, False))))


def test_blocks_of_the_article():
    page = PAGE.format(title="A title", first="First  \n line")
    assert text(page) == "A title First line next & <x> é abc d one two"


def test_odd_markup():
    assert text(None) == text("") == ""
    assert text("plain a < b &amp c") == "plain a < b & c"
    assert text("<p>one<p>two</div></p></b>three") == "one two three"
    assert text("<div title='a > b'>x</div><p cla") == "x"
    assert text("<!-- <p>no</p> -->yes<!-- open <p>no") == "yes"
    assert text('<script>if (a < b) "</scrip" </SCRIPT >x<script>open') == "x"
    assert text('<p class="a>x</p>') == "x"
    assert text("<article>" * 2000 + "deep") == "deep"
    assert text("<main>a<nav>b</nav><div hidden>c</div><div style='display: none'>d</div></main>e") == "a"
    assert text("<article>body</article><article class='comment'>said</article>") == "body"


def test_a_host_without_main_elements(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(n))
    rows, expected = [], {}
    for i in range(12):
        title, body = words(4), [words(30) for _ in range(rng.randint(1, 4))]
        paragraphs = "".join(f"<p>{b}" for b in body)
        rows.append((i, f"http://x.org/{i}", f"<html><body><div class=top>Our site {i}</div><div class=content><h2>{title}</h2>"
                     f"{paragraphs}<div>Always the same words</div></div><div class=low>Bottom</div></body></html>", i))
        expected[i] = " ".join([title, *body])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    found = {r.page_id: r for r in extract_main_text(pages).collect()}
    assert {i: r.text for i, r in found.items()} == expected
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_copies_are_not_taken_for_a_template(spark):
    page = PAGE.format(title="Same", first="words here")
    rows = [(i, "http://copies.org/a", page) for i in range(9)] + [(9, None, None), (None, "no url", "<p>x"), (9, None, None)]
    rows += [(20 + i, f"https://one{i}.net", page) for i in range(2)]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == ("x" if r.page_id is None else "" if r.page_id == 9 else text(page))
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens_close_what_they_open():
    tokens, _, has_main = read(PAGE.format(title="t", first="f"))
    assert has_main and sum(t.text is not None for t in tokens) == 14


def test_no_page_of_a_host_is_emptied_by_its_container(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    rows, expected = [], {}

    def add(host, content, body="", name="post"):
        i = len(rows)
        rows.append((i, f"http://{host}/{i}", f"<html><body{body}><div class=top>Top {i}</div><div class={name}><p>{content}</div></body></html>"))
        expected[i] = content

    for i in range(10):
        add("layouts.org", words(40), name="post" if i < 7 else "story")
    for i in range(8):
        add("bodies.org", words(30 + 10 * i), f' class="page postid-{i}"')
    for i in range(8):
        add("long.org", words(5000 if i == 3 else 30), name="essay" if i == 3 else "post")
    expected[21] = f"Top 21 {expected[21]}"  # the only page of its layout keeps all its text
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected
