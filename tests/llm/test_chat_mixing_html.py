"""Chat formatting, source mixing and page extraction."""

import hashlib

import pytest
from conftest import docs  # noqa: F401

from veritab.llm import chat, host_paths, mixing, queries


def test_chat_query_equals_brute_force(spark, sf_dir):
    rows = {}
    for r in queries.table(spark, sf_dir, "conversations").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.QUERIES["op3_chat_format"](spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for k, turns in rows.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(said)
        assert got[k].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[k].rewrites_at == -1


def test_escapes_are_reversible(rng):
    for _ in range(500):
        t = "".join(rng.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "[", "<", "x", "\n", "[TEXT]"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_spans_and_rewritten_history():
    turns = [("user", "hi"), ("assistant", ""), ("tool", "a[/ROLE]b"), ("assistant", "bye")]
    out, spans, rewritten = chat.locate(turns, chat.instruct)
    assert rewritten == -1 and [chat.unescape(out[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert [chat.read_role(out[a:b]) for a, b, _, _ in spans] == [r for r, _ in turns]
    last_only = lambda ts: "".join(f"<{r}>{t if i == len(ts) - 1 else t[:1]}" for i, (r, t) in enumerate(ts))
    _, spans, rewritten = chat.locate([("a", "first"), ("b", "second")], last_only)
    assert rewritten == 1 and spans[0] == (-1, -1, -1, -1)
    assert chat.locate([], chat.instruct) == ("<s>", [], -1)


def test_chat_edges(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, 1, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, 0, "user", "y" * 200_000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[2].formatted_chars > 200_000
    assert chat.digests(chat.format_conversations(rows.limit(0))).count() == 0


def test_poisson_rates_are_met(spark):
    rows = [(i, f"t{i}") for i in range(6000)]
    d = docs(spark, rows)
    out = mixing.mix(d, {"s0": 0.7, "s1": 0.2, "s2": 0.1, "unused": 5.0}, total=12_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["s0"] == pytest.approx(12_000 * 0.7, rel=0.1) and n["s1"] == pytest.approx(12_000 * 0.2, rel=0.15)
    again = mixing.mix(d.repartition(7), {"s0": 0.7, "s1": 0.2, "s2": 0.1, "unused": 5.0}, total=12_000)
    assert sorted((r.doc_id, r.copy) for r in again.select("doc_id", "copy").collect()) == sorted((r.doc_id, r.copy) for r in out.select("doc_id", "copy").collect())
    per = sorted(r["count"] for r in mixing.mix(d, {"s0": 1.0, "s1": 1.0, "s2": 1.0}, total=6000).groupBy("doc_id").count().collect())
    assert sum(per) / 6000 == pytest.approx(1.0, abs=0.06) and sum(x * x for x in per) / 6000 == pytest.approx(2.0, abs=0.2)
    assert out.columns == [*d.columns, "copy"]


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(1, "a", None), (None, None, "s"), (1, "a", None)], "doc_id long, text string, source string")
    out = mixing.mix(rows, {"": 1.0, "s": 1.0}, total=6000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n[None] == pytest.approx(3000, rel=0.15) and n["s"] == pytest.approx(3000, rel=0.15)
    assert mixing.mix(rows.limit(0)).count() == 0


ARTICLE = "<div class='post-{n}'><h1>Title &amp; more</h1><p>First   paragraph of the story {n}, long enough to matter.</p><p>Second <b>bold</b> line<br>goes on.</p></div>"
PAGE = "<html><head><title>x</title><style>p{{}}</style></head><body><nav><a href=/>menu</a></nav><div class=sidebar>side side side</div><!-- c -->{a}<div class=comments><p>reader says a lot of words about this</p></div><form>f</form><footer>foot</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"https://a.io/{i}", PAGE.format(a=ARTICLE.format(n=i))) for i in range(5)]
    rows += [(10, "https://b.io/x", None), (11, None, "<p>only text"), (12, "https://b.io/y", ""), (13, "https://a.io/z", "<div><p>unlike the others"), (13, "https://a.io/z", "<div><p>unlike the others"), (14, "https://c.io", "<p>" + "w " * 200_000)]
    got = {r.page_id: r for r in host_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].text == f"Title & more\nFirst paragraph of the story {i}, long enough to matter.\nSecond bold line goes on."
        assert got[i].n_chars == len(got[i].text) and "post-#" in got[i].path
    assert got[10].text == got[12].text == "" and got[11].text == "only text" and got[13].text == "unlike the others"
    assert got[14].n_chars == 399_999
    assert host_paths.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_query_drops_what_is_around(spark, sf_dir):
    for r in queries.QUERIES["op10_host_paths"](spark, sf_dir).collect():
        assert "©" not in r.text and "track(" not in r.text and not r.text.startswith("<")


def test_long_nested_articles_keep_heading_and_lead():
    page = "<body><div class=post><h1>Title</h1><p>The lead of it.</p><div class=body>{}</div></div></body>"
    for n in (1, 200):
        p = host_paths.Page(page.format("<p>A paragraph of the body.</p>" * n))
        assert [path for path, _ in p.votes()] == [">body>div.post"]
        for path in (">body>div.post>div.body", ">body>div.post", None):
            assert p.text(path).startswith("Title\nThe lead of it.\nA paragraph")


def test_a_page_of_another_layout_keeps_its_article():
    article = "<div class=story>" + "<p>A paragraph of the story.</p>" * 9 + "</div>"
    page = host_paths.Page(f"<body>{article}<div class=content>By a writer</div></body>")
    assert page.text(">body>div.content") == page.text(None) == "\n".join(["A paragraph of the story."] * 9)
    assert host_paths.Page("<body><div class=content><p>By a writer</div></body>").text(">body>div.content") == "By a writer"


def test_class_words_of_wrappers_keep_the_article():
    story = "".join(f"<p>Paragraph {i} of the story.</p>" for i in range(4))
    text = "\n".join(f"Paragraph {i} of the story." for i in range(4))
    for name in ("content-sidebar-wrap", "has-sidebar", "no-comments", "main social"):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", f"<div>{story}</div>"):
            page = f"<body><div class='{name}'>{inner}<div class=sidebar><p>side</p></div></div><footer>foot</footer></body>"
            assert host_paths.Page(page).text(None) == (text if name != "no-comments" or "<div>" not in inner else text + "\nside"), (name, inner)
    comments = "<div class=comments>" + "<p>A reader says a lot of words.</p>" * 40 + "</div>"
    assert host_paths.Page(f"<body><div>{story}</div>{comments}</body>").text(None) == text
    assert host_paths.Page("<body><div class=notice>All there is</div></body>").text(None) == "All there is"


def test_rows_without_a_conversation_are_apart(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_conversations(rows)).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 0), (0, 1, 1), (1, 1, 0)]


def test_rows_without_an_id_draw_by_their_texts(spark):
    rows = spark.createDataFrame([(None, f"text {i}", "s", i) for i in range(1000)] + [(1, "x", None, 0), (1, "x", None, 0)], "doc_id long, text string, source string, copy int")
    mixed = mixing.mix(rows, {"s": 1.0, "": 1.0}, total=1000)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "copy_"]
    assert 400 <= mixed.where("source = 's'").count() <= 600
    assert mixing.mix(rows, name=None).columns == rows.columns


def test_deep_and_broken_pages():
    for page in ("<div>" * 20_000 + "text", "<b>" * 16_000 + "</i>" * 16_000 + "text", "<div class=sidebar>" * 20_000 + "text", "<i><div>" + "<b>" * 16_000 + "</i>" * 16_000 + "text"):
        assert host_paths.Page(page).text(None) == "text"


def test_a_conversation_with_all_signs_for_private_use():
    text = "".join(map(chr, range(0xE000, 0xF900)))
    out, spans, rewritten = chat.locate([("user", text), ("assistant", "ok")], chat.instruct)
    assert rewritten == -1 and [out[a:b] for _, _, a, b in spans] == [text, "ok"]
