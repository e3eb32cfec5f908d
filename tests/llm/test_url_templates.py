import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidegraph.llm import url_templates as u
from tidegraph.llm.common import prepare
from tidegraph.llm.queries import QUERIES

RULES = [u.Rule("allow", "com", "/"), u.Rule("block", "example.com", "/en/"), u.Rule("allow", "www.example.com", "/en/"), u.Rule("block", "net", "/es/"), u.Rule("block", "net", "/fr/")]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fit, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block", r.path), default=None)


def chi_square(x, y):
    n, m = sum(x), sum(y)
    return sum((a * m - b * n) ** 2 / (n * m * (a + b)) for a, b in zip(x, y) if a + b)


def brute(urls, rules):
    """(host, path, rule, template, purity, verdict) of each URL, by a recursion over each host's tree."""
    rows = [(*cut(url),) for url in urls]
    labels = [rule_of(h, p, rules) for h, p in rows]
    template = {}

    def grow(members, at, depth):
        deeper = defaultdict(list)
        for k, rest in members:
            if depth == u.DEPTH or not rest:
                template[k] = at + ("/**" if rest else "")
            else:
                deeper[rest[0]].append((k, rest[1:]))
        total = sum(map(len, deeper.values()))
        branches = defaultdict(list)
        for segment, m in deeper.items():
            stays = len(m) >= u.SUPPORT and len(m) * u.SHARE >= total
            branches["'" + segment if stays else "{n}" if re.fullmatch("[0-9]+", segment) else "*"].extend(m)
        tell = {b: Counter(labels[k].verdict if labels[k] else None for k, _ in m) for b, m in branches.items()}
        mix = {b: (c["block"], c["allow"], c[None]) for b, c in tell.items()}
        order = sorted(branches, key=lambda b: (mix[b][0] / sum(mix[b]), mix[b][1] / sum(mix[b]), b))
        groups = []
        for before, b in zip([None, *order], order):
            if before is None or chi_square(mix[b], mix[before]) >= u.ALIKE:
                groups.append([])
            groups[-1].append(b)
        for g in groups:
            grow([x for b in g for x in branches[b]], f"{at}/{'|'.join(sorted(g))}", depth + 1)

    hosts = defaultdict(list)
    for k, (h, p) in enumerate(rows):
        hosts[h].append((k, re.sub("^/", "", p).split("/") if p else []))
    for h, members in hosts.items():
        grow(members, h, 0)
    blocked = Counter(template[k] for k, r in enumerate(labels) if r and r.verdict == "block")
    labelled = Counter(template[k] for k, r in enumerate(labels) if r)
    out = []
    for k, (h, p) in enumerate(rows):
        t = template[k]
        purity = (blocked[t] + u.WEIGHT / 2) / (labelled[t] + u.WEIGHT)
        r = labels[k]
        out.append((k, h, p, r.host + r.path if r else None, t, purity, r.verdict if r else "block" if purity >= u.REJECT else "allow"))
    return out


def urls(seed=1):
    rng = random.Random(seed)
    hosts = ["a.example.net", "a.example.com", "www.example.com", "x.www.example.com", "EXAMPLE.com", "notexample.com", "net", "b.org", "c.co", "d.net"]
    out = []
    for _ in range(600):
        host = rng.choice(hosts[:2] if rng.random() < 0.5 else hosts)
        path = rng.choice(["", "/", f"/{rng.choice(['en', 'es', 'fr', 'de', 'EN'])}/{rng.randrange(500)}{rng.choice(['', '/', '.html', '/a/b/c/d', '//'])}", "/es", "/shop/es/1"])
        out.append(f"{rng.choice(['http', 'https'])}://{host}{path}{rng.choice(['', '?a=/fr/://x', '#t'])}")
    return out + [None, "", "no scheme", "://", "http://", "http:///es/x", "x://y://z/q", "http://a.net?x", "http://é.net/fr/ü\n/x", "http://a.net/es/" + "s/" * 5000, "http://" + "l." * 3000 + "net/fr/", "http://ÀB.net/*/{n}", "http://ÀB.net/'en/{n}"]


def run(spark, rows, rules):
    prepare(spark)
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumns({"host": F.lit(1), "rest": F.lit(2), "template": F.lit(3)}).repartition(3)
    return sorted(tuple(r) for r in u.judged(df, rules, ["page_id"]).collect())


def test_templates_equal_a_recursion(spark):
    rows = urls()
    got, want = run(spark, rows, RULES), brute(rows, RULES)
    assert [r[:5] + r[6:] for r in got] == [r[:5] + r[6:] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-12 for a, b in zip(got, want))


def test_rule_ties_and_no_rules(spark):
    rules = [u.Rule("allow", "a.b", "/x"), u.Rule("block", "a.b", "/x"), u.Rule("allow", "b", "/x/y"), u.Rule("block", "c.b", "/x"), u.Rule("allow", "b", "/x/z")]
    rows = ["http://a.b/x", "http://c.b/x/y", "http://c.b/x/z", "http://b/x/y", "http://q/x"]
    assert [(r[3], r[6]) for r in run(spark, rows, rules)] == [("a.b/x", "block"), ("c.b/x", "block"), ("c.b/x", "block"), ("b/x/y", "allow"), (None, "allow")]
    assert {r[6] for r in run(spark, urls(), [])} == {"allow"}
    assert run(spark, [], RULES) == []


def test_a_blocked_branch_takes_its_unlabelled_urls_along(spark):
    rows = [f"http://h.net/es/item/{k}" for k in range(12)] + [f"http://h.net/news/{k}" for k in range(12)] + ["http://h.net/es/item/x?"] * 2
    rules = [u.Rule("block", "h.net", f"/es/item/{k}") for k in range(2, 10)] + [u.Rule("allow", "h.net", "/news/1")]
    got = run(spark, rows, rules)
    assert [r[6] for r in got[:12]] == ["block"] * 12 and [r[6] for r in got[12:24]] == ["allow"] * 12


def test_query(spark, tmp_path):
    prepare(spark)
    rows = urls(2)
    spark.createDataFrame([(k, url, "<html>") for k, url in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in QUERIES["op12_path_templates"](spark, str(tmp_path)).collect())
    assert got == [(*r[:4], r[6]) for r in brute(rows, RULES)]
