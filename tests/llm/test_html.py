from sievelog.llm import html as H

MENU = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now, a long advert text that nobody wants.</div>'
FOOT = '<div id="comments"><p>First comment, long enough to look like text.</p></div><footer>&copy; us</footer>'


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{MENU}{body}{FOOT}</body></html>"


def test_text_of_a_page():
    body = "<article><h1>A &amp; B</h1><p>One <b>bo</b>ld\n  word.<br>Next&nbsp;line<p>Two<ul><li>x<li>y</ul><form>q</form></article>"
    assert H.text_on(page(body), None) == "A & B One bold word. Next line Two x y"
    assert H.text_on(page(body), "/body/article") == "A & B One bold word. Next line Two x y"


def test_cut_off_and_empty_pages():
    assert H.text_on(None, None) == H.text_on("", "/body") == H.text_on("<script>x", None) == ""
    assert H.text_on("just text", None) == "just text"
    assert H.text_on("<body><article><p>cut o", None) == "cut o"


def test_pages_of_a_host_agree_on_a_path(spark):
    long = "<div class='story-{n}'><p>" + "Much text of the story. " * 20 + "</p></div>"
    rows = [(i, f"https://h.example/{i}", page(long.replace("{n}", str(i)) + "<div class='extra'><p>Short.</p></div>")) for i in range(9)]
    # on this page another container is longer than the story
    odd = "<div class='story-77'><p>Brief story.</p></div><div class='extra'><p>" + "Unrelated words " * 60 + "</p></div>"
    rows += [(50, "https://h.example/50", page(odd)), (60, None, page("<main>Own</main>")), (61, "no url", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract(df).collect()}
    assert found[50] == "Brief story." and found[60] == "Own" and found[61] == ""
    assert all(found[i] == ("Much text of the story. " * 20).strip() for i in range(9))
    paths = {r.host: r.path for r in H.host_paths(df).collect()}
    assert paths["h.example"] == "/body/div.story-"


def test_many_hosts_and_clashing_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/", page(f"<article>t{i}</article>")) for i in range(12)], "page_id long, url string, html string")
    df = df.withColumns({n: F.lit("x") for n in ("path", "host", "text", "_host", "votes")})
    monkeypatch.setattr(H, "BROADCAST_HOSTS", 0)
    assert {(r.page_id, r.text) for r in H.extract(df).collect()} == {(i, f"t{i}") for i in range(12)}
    assert H.extract(df.where("false")).count() == 0


def test_deep_broken_and_long_pages_take_linear_time():
    import time

    def seconds(n):
        body = "".join(f"<div class=c{i % 7}><i>word{i} <article><p>" if i % 50 == 0 else f"<div><i>t{i} " for i in range(n))
        start = time.perf_counter()
        assert H.text_on(page(body), None) and H.votes(page(body))
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(80_000) < 40 * max(seconds(4_000), 0.05)


def test_long_paths_are_containers_too(spark):
    name = "a-rather-long-class-name-of-a-wrapper"
    body = f"<div class={name}>" * 30 + "<div class='the-story-of-this-page'><p>" + "The story itself. " * 30 + "</p></div>" + "</div>" * 30
    body += "<div class=beside><p>" + "Beside it. " * 9 + "</p></div>"
    df = spark.createDataFrame([(i, "http://deep.example/", page(body)) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {("The story itself. " * 30).strip()}
    assert {r.path[0] for r in H.host_paths(df).collect()} == {"#"}
