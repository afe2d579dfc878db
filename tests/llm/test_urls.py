"""URL rules and path templates against plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from flowlink.llm import urls
from flowlink.llm.queries import URL_RULES

ASCII = str.maketrans(urls.UPPER, urls.LOWER)
VARIABLE = re.compile(r"^([0-9]+|[0-9a-fA-F-]{16,}|.*[0-9].*[0-9].*[0-9].*|.{40,}|([^-]+-){3,}[^-]+)(\.[A-Za-z]{1,5})?$")


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(ASCII), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def pattern(path):
    out = []
    for s in [s for s in path.split("/") if s]:
        end = re.search(r"\.[A-Za-z]{1,5}$", s)
        out.append("*" + (end[0] if end else "") if VARIABLE.match(s) else s)
    return tuple(out)


def beyond_chance(bad, known, all_bad, all_known, siblings):
    """Whether so many bad ones of so many labels are no draw from all of them."""
    rest = all_known - known
    if not known or not rest:
        return False
    if known <= urls.FEW:
        drawn = [math.comb(all_bad, i) * math.comb(all_known - all_bad, known - i) for i in range(known + 1)]
        tail = 2 * min(sum(drawn[bad:]), sum(drawn[: bad + 1])) / math.comb(all_known, known)
        return tail <= urls.CHANCE * min(1, urls.SIBLINGS / siblings)
    share = all_bad / all_known
    error = math.sqrt(share * (1 - share) * (1 / known + 1 / rest))
    bar = urls.APART if siblings <= urls.SIBLINGS else math.sqrt(urls.APART**2 + 2 * math.log(siblings / urls.SIBLINGS))
    return error > 0 and abs(bad / known - (all_bad - bad) / rest) >= bar * error


def brute(pages, bad):
    """page -> (host, path, rule, verdict), from one pass over a tree of counters."""
    parsed = [(p, *parse(u)) for p, u in pages]
    rows = [(h, pattern(t), bad.get(p)) for p, h, t in parsed]
    template = {(h, s): "" for h, s, _ in rows}
    for level in range(max([len(s) for _, s, _ in rows], default=0)):
        stats = defaultdict(lambda: [0, 0, 0])
        for h, s, b in rows:
            if len(s) > level:
                x = stats[h, template[h, s], s[level]]
                x[0] += 1
                x[1] += b is not None
                x[2] += b or 0
        parents = defaultdict(lambda: [0, 0, 0])
        for (h, t, _), x in stats.items():
            for i in range(3):
                parents[h, t][i] += x[i]
        grown = {}
        for (h, t, s), (n, known, b) in stats.items():
            all_n, all_known, all_b = parents[h, t]
            siblings = sum(x[1] > 0 for (h2, t2, _), x in stats.items() if (h2, t2) == (h, t))
            own = 0 < all_b < all_known and beyond_chance(b, known, all_b, all_known, siblings)
            grown[h, t, s] = t + "/" + (s if own else s if s.startswith("*") else "*")
        template = {(h, s): grown[h, t, s[level]] if len(s) > level else t for (h, s), t in template.items()}
    leaf, host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, s, b in rows:
        for x in (leaf[h, template[h, s]], host[h]):
            x[0] += b is not None
            x[1] += b or 0
    known, wrong = sum(x[0] for x in host.values()), sum(x[1] for x in host.values())
    every = wrong / known if known else 0.0
    out = {}
    for p, h, t in parsed:
        prior = (host[h][1] + urls.WEIGHT * every) / (host[h][0] + urls.WEIGHT)
        n, b = leaf[h, template[h, pattern(t)]]
        impure = (b + urls.WEIGHT * prior) / (n + urls.WEIGHT) >= urls.IMPURE
        rule, verdict = ruled(h, t)
        out[p] = (h, t, rule, verdict or ("block" if impure else "allow"), template[h, pattern(t)])
    return out


ODD_URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://EXAMPLE.Net/EN/1", "http://example.net/en/1", "http://a.example.com/de/x?y=/en/",
    "https://É.Org/fr/", "http://x.org/fr/1#a?b", "http://badnet/", "http://net/", "http://net", "http://a.net?x", "http://a://b.net/c",
    "http://h.de/" + "/".join("abcdefghijkl"), "http://h.de//a//b/", "ftp://u@h:8/p", "http://h.de/a\nb/c",
]


def table(spark, pages, bad):
    return (
        spark.createDataFrame(pages, "page_id bigint, url string").repartition(3),
        spark.createDataFrame([*bad.items(), (None, 1)], "page_id bigint, bad int"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_match_plain_python(spark, seed):
    draw = random.Random(seed)
    pages, bad = list(enumerate(ODD_URLS)), {}
    for i in range(100, 900):
        host = draw.choice(["one.test", "two.test", "WWW.two.test", "a.example.com", "b.example.net"])
        part = draw.choice(["news", "blog", "ads", "shop"])
        tail = draw.choice([str(i), f"{i}.html", f"a-long-slug-of-{i}", "about"])
        pages.append((i, f"http://{host}/{part}/{tail}"))
        if draw.random() < 0.7:
            bad[i] = int(draw.random() < (0.95 if part == "ads" and host == "one.test" else 0.15))
    left, right = table(spark, pages, bad)
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(left, right, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template").collect()}
    want = brute(pages, bad)
    assert got == want
    judged = {(v[0], v[1].split("/")[1]): v[3] for v in want.values() if v[0] == "one.test"}
    assert judged["one.test", "ads"] == "block" and judged["one.test", "news"] == "allow"


def test_small_sections_and_deep_ones_are_branches(spark):
    pages, bad = [], {}

    def add(host, path, label, many):
        for _ in range(many):
            bad[len(pages)] = label
            pages.append((len(pages), f"http://{host}/{path}/{1000 + len(pages)}"))

    words = [a + b for a in ("red", "blue", "green", "grey", "pink") for b in ("tree", "bird", "lake", "hill", "road", "town")]
    for word in words:
        add("even.test", word, int(word == "pinkbird"), 20)
        add("foul.test", word, int(word != "pinkbird"), 20)
    add("deep.test", "a/b/c/d/e/f/g/h/good", 0, 30)
    add("deep.test", "a/b/c/d/e/f/g/h/wrong", 1, 30)
    add("long.test", "/".join(["s"] * 300), 0, 1)
    add("few.test", "fine", 0, 300)
    add("few.test", "wrong", 1, 9)
    add("few.test", "awry", 1, 4)
    left, right = table(spark, pages, bad)
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(left, right).collect()}
    assert got == {p: "block" if bad[p] else "allow" for p, _ in pages}


def test_no_labels_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (1, "http://a.b/c", "x"), (None, None, "y")], "page_id bigint, url string, verdict string")
    labels = spark.createDataFrame([], "page_id bigint, bad int")
    out = urls.filter_urls(pages, labels)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "template", "purity", "verdict"]
    assert sorted(r["verdict"] for r in out.collect()) == ["allow"] * 3
    assert urls.filter_urls(pages.limit(0), labels).collect() == []


def test_no_python_runs(spark):
    left, right = table(spark, [(1, "http://a.b/c/1")], {1: 1})
    plan = urls.filter_urls(left, right, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
