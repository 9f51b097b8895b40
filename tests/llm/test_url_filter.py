import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillsieve.llm._scratch import Scratch
from quillsieve.llm.url_filter import host_and_path, judge, matching_rule, propagate

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://A.Example.NET/en/x?q=/a#b", "a.example.net", "/en/x", "example.net/en/"), ("http://example.net", "example.net", "", None), ("x://net/", "net", "/", "net/"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None), ("ftp://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/"), ("no scheme", "", "", None), (None, "", "", None),
    ("http://ÉÀ.org?fr/", "ÉÀ.org".replace("A", "A"), "", None), ("http://a.org/fr/://x", "a.org", "/fr/://x", "org/fr/"), ("a://b.net\n/x", "b.net\n", "/x", None),
])
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "u string")
    h, p = host_and_path(F.col("u"))
    r = df.select(h.alias("h"), p.alias("p")).select("h", "p", matching_rule(F.col("h"), F.col("p"), RULES).alias("r")).first()
    assert (r.h, r.p, r.r and r.r.rule) == (host, path, rule)


def test_propagation_equals_power_iteration(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "e", 1), ("c", "e", 3)]
    seeds = [(0, "a", 1.0), (1, "e", 0.5), (1, "c", 0.5)]
    df = propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind int, host string, share double"), Scratch(spark, "t"), rounds=7)
    got = {(r.kind, r.host): r.score for r in df.collect()}
    for kind in (0, 1):
        edges = [(s, d, n) if kind == 0 else (d, s, n) for s, d, n in links]
        out = {}
        for s, _, n in edges:
            out[s] = out.get(s, 0) + n
        start = {h: w for k, h, w in seeds if k == kind}
        score = dict(start)
        for _ in range(7):
            new = {h: 0.15 * w for h, w in start.items()}
            for s, d, n in edges:
                if s in score:
                    new[d] = new.get(d, 0) + 0.85 * score[s] * n / out[s]
            score = new
        assert {h: w for (k, h), w in got.items() if k == kind} == pytest.approx(score)


def brute(rows, rules, threshold=0.5, damping=0.85, rounds=29):
    """judge() in plain Python."""
    pages = []
    for page, url, html in rows:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = max(((len(r), v, r) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None)
        pages.append((page, host, path, html or "", fit))
    links = Counter()
    for _, host, _, html, _ in pages:
        for to in re.findall(r"""(?i)<[a-z][^>]*?\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html):
            if host and host != to.lower():
                links[host, to.lower()] += 1
    scores = []
    for kind in ("allow", "block"):
        seeds = Counter(host for _, host, _, _, fit in pages if fit and host and fit[1] == kind)
        edges = [(a, b, n) if kind == "allow" else (b, a, n) for (a, b), n in links.items()]
        out = Counter()
        for a, _, n in edges:
            out[a] += n
        share = {h: n / sum(seeds.values()) for h, n in seeds.items()}
        score = share
        for _ in range(rounds):
            new = {h: x * (1 - damping) for h, x in share.items()}
            for a, b, n in edges:
                new[b] = new.get(b, 0) + damping * score.get(a, 0) * n / out[a]
            score = new
        scores.append(score)
    for page, host, path, _, fit in pages:
        trust, distrust = (x.get(host, 0) for x in scores)
        yield page, host, path, fit and fit[2], fit[1] if fit else "block" if distrust > threshold * (trust + distrust) else "allow", round(trust, 9), round(distrust, 9)


def test_judge_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.org", "b.org", "x.example.net", "m.example.com", "evil.net", "farm.com", "Friend.com", "lone.io", "q.net"]
    page = lambda: "".join(rng.choice([f'<a href="https://{h}/p">', f"<A  class=x HREF = '//{h}?q'>", f"<link href=http://{h}>", '<a href="/rel">', "<a href=mailto:x@y>"]) for h in rng.choices(hosts, k=rng.randint(0, 5)))
    rows = [(k, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/fr/1', '/en/', '/de/x?y', '', '#z', '/'])}", page()) for k in range(60)]
    rows += [(None, "http://farm.com/", None), (7, None, page()), (8, "x" * 200_000, "y" * 200_000), (9, "http://" + "h" * 100_000 + "/" + "p" * 100_000, page()), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "fit", "kind", "score", "share", "n", "trust", "distrust")})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in judge(df, RULES).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, RULES), key=str)
    assert len({r[4] for r in got if r[3] is None}) == 2


def test_verdicts(spark):
    link = lambda *hosts: "".join(f'<a class=x href="//{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://good.org/fr/", link("Friend.com"), "x"), (2, "http://friend.com/", None, "x"), (3, "http://bad.net/", "", "x"), (4, "http://farm.com/", link("bad.net", "bad.net"), "x"),
        (5, "http://alone.com/", '<a href="/rel">', "x"), (6, None, link("bad.net"), "x"), (None, "http://x.example.net/en/", None, "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, trust string")
    got = {r.page_id: r.verdict for r in judge(df, RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", None: "allow"}
    assert judge(df.limit(0), RULES).count() == 0
