from sievelog.llm import html as H

LONG = "Much text of the article. " * 20
ARTICLE = f"<article><h1>Head</h1><p class=lead>Lead.</p><div class=content><p>{LONG}</p></div><section class=notes-on-it>End.</section></article>"


def page(body):
    return f"<html><body><nav>Menu</nav>{body}<div id=comments>A comment</div><footer>us</footer></body></html>"


def test_heading_lead_and_other_sections_stay_with_the_inner_container(spark):
    rows = [(i, f"https://h.example/{i}", page(ARTICLE)) for i in range(4)]
    rows += [(9, "https://m.example/", page(f"<main><h1>Head</h1><div><article>{LONG}</article></div><p>Last.</p></main>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract(df).collect()}
    assert {found[i] for i in range(4)} == {f"Head Lead. {LONG.strip()} End."}
    assert found[9] == f"Head {LONG.strip()} Last."


def test_names_inside_an_article():
    parts = [
        "<h2 id=related-work>Related work</h2>", "<section id=search>How we search.</section>",
        "<div class=entry-header>By us.</div>", "<h3 class=menu>Menus</h3>",
    ]
    body = f"<article>{''.join(parts)}<div class='box share'>Share this</div><div role=navigation>Next</div><p>{LONG}</p></article>"
    assert H.text_on(page(body), None) == f"Related work How we search. By us. Menus {LONG.strip()}"
    # around an article they count as before, but for headings
    body = f"<main><h2 id=related-work>Related work</h2><div class=share-box>Share this</div><p>{LONG}</p></main>"
    assert H.text_on(page(body), None) == f"Related work {LONG.strip()}"
