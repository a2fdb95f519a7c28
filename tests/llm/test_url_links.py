"""Redirect equivalence against union-find over random pages, and links as they stand in pages."""

import random
import re
from urllib.parse import urljoin

import pytest

from vozlake.llm import urls


def plain(url):
    """Without dot segments, which ``urljoin`` leaves in addresses with a host."""
    origin, rest = re.match(r"(?s)(.*?://[^/?#]*)(.*)", url).groups()
    return origin + urljoin("http://h/", rest)[8:] if rest.startswith("/") else url


def node(url):
    """Host without www. or m., path without dot segments and final slash, query without tracking parameters."""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", plain(url)).groups()
    query = re.search(r"\?([^#]*)", url)
    kept = [p for p in query[1].split("&") if not re.match("(utm_[a-z]+|ref)=", p)] if query else []
    return re.sub(r"^(www|m)\.", "", host.lower()) + path.rstrip("/") + ("?" + "&".join(kept) if any(kept) else "")


def rule_of(url):
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    fitting = [(len(h + p), v == "allow", v, h + p) for v, h, p in urls.RULES
               if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
    return max(fitting, default=(0, 0, None, None))[2:]


def test_union_find(spark):
    rnd = random.Random(11)
    hosts = ["a.org", "www.a.org", "b.org", "M.b.org", "x.net", "example.com", "www.example.com", "c.io"]
    folders = ["/", "/es/", "/fr/q/", "/en/", "/d/e/f/", ""]
    forms = ["../p{}", "./p{}", "p{}", "?id={}&amp;utm_a=1", "/d/p{}", "/es/p{}", "//b.org/d/p{}", "http://x.net/fr/p{}", "HTTPS://c.io/d/../p{}",
             "../../../../p{}", "#p{}", "mailto:p{}", "p{}/..", "p{}/."]

    def link():
        return rnd.choice(forms).format(rnd.randrange(25))

    rows, edges = [], []
    for i in range(700):
        folder = rnd.choice(folders)
        url = f"http://{rnd.choice(hosts)}{folder}" + (f"p{rnd.randrange(25)}" if folder else "") + rnd.choice(["", "", "?id=3", "?ref=7", "#top"])
        html, base = "<html>", url
        if rnd.random() < 0.1:
            html, base = html + "<base href='/d/q/'>", urljoin(url, "/d/q/")
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            to = link()
            html += rnd.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical />", '<meta http-equiv=refresh content="0; url={}">']).format(to)
            to = to.replace("&amp;", "&")
            if not to.startswith(("#", "mailto:")):
                edges.append((url, plain(urljoin(base, to))))
        rows.append((i, url, html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(set(map(tuple, urls.links(pages).collect()))) == sorted(set(edges))

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(node(a))] = find(node(b))
    addresses = [u for _, u, _ in rows] + [b for _, b in edges]
    barred = {find(node(u)) for u in addresses if rule_of(u)[0] == "block"}
    got = urls.judge(pages).collect()
    want = {}
    for i, url, _ in rows:
        verdict, rule = rule_of(url)
        want[i] = (rule, verdict or ("block" if find(node(url)) in barred else "allow"))
    assert {r.page_id: (r.rule, r.verdict) for r in got} == want and len(got) == len(rows)
    by_alias = [i for i, (rule, verdict) in want.items() if rule is None and verdict == "block"]
    assert by_alias and any(rule is None and verdict == "allow" for rule, verdict in want.values())


@pytest.mark.parametrize("html, wanted", [
    ('<link rel="alternate canonical" href="a b.html">', ["http://h/d/a b.html"]),
    ("<link data-rel=canonical href=x>", []), ("<link rel=canonical>", []), ("<link rel=canonical href=x <b>", []),
    ("<link\nrel = 'Canonical'\nhref = 'x?a=1&#38;b=2'>", ["http://h/d/x?a=1&b=2"]),
    ("""<meta http-equiv="Refresh" content="3;URL='y'"><link rel=canonical href=x>""", ["http://h/d/x", "http://h/d/y"]),
    ("<base href='//k/z/w'><link rel=canonical href=.>", ["http://k/z/"]),
    ("canonical " + "<link " * 50_000, []), ("<link rel=canonical href=" + "/.." * 300 + "/x>", ["http://h/x"]),
    ("<link rel=canonical href=/" + "a/" * 50_000 + "../x>", ["http://h/" + "a/" * 49_999 + "x"]),
])
def test_tags(spark, html, wanted):
    page = spark.createDataFrame([("http://h/d/p?q", html)], "url string, html string")
    assert sorted(r.dst for r in urls.links(page).collect()) == wanted
