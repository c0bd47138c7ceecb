"""Pages with broken markup are read in linear time and as the pattern for tags says; the host's path changes an odd page."""

import random
import re
import time

import pytest

from veritab.llm import host_paths
from veritab.llm.host_paths import Page, Tags

PATTERN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("short", [0, 3, 2000])
def test_tags_equal_the_pattern(monkeypatch, short):
    monkeypatch.setattr(host_paths, "_SHORT", short)
    rng = random.Random(short)
    for _ in range(4000):
        page = "".join(rng.choice(["<", ">", '"', "'", "a", "!", "-", "--", "<!--", "-->", "/", " ", "<a ", "</b>", 'x="1"', "?", "<p>"]) for _ in range(rng.randint(0, 25)))
        want = [(m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or "") for m in PATTERN.finditer(page)]
        tags, at, got = Tags(page), 0, []
        while t := tags.next(at):
            got.append(t)
            at = t[1]
        assert got == want, page


@pytest.mark.parametrize("piece", ['<a href="x', "<!-", "<a ", '<a "', "<script>x</script", "<a href=\"x'>", "<a href='x\">\"", "</", "<style", "<div><p>"])
def test_a_megabyte_of_broken_tags(piece):
    began = time.process_time()
    Page(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 15


def test_the_host_changes_an_odd_page(spark):
    body = lambda i, n: " ".join(f"Word{i} and more of article {i} sentence {k}." for k in range(n))
    plain = lambda i: f"<html><body><div class='content'><p>{body(i, 12)}</p></div></body></html>"
    odd = f"<html><body><div class='content'><p>{body(9, 12)}</p></div><div class='extra'>{body(77, 5)}</div></body></html>"
    rows = [(i, f"https://host.example/{i}", plain(i)) for i in range(5)] + [(9, "https://host.example/9", odd), (10, "https://alone.example/1", odd)]
    got = {r.page_id: r.text for r in host_paths.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[9] == body(9, 12)  # the page's own best container holds both
    assert got[10] == f"{body(9, 12)}\n{body(77, 5)}"
    assert [got[i] for i in range(5)] == [body(i, 12) for i in range(5)]
