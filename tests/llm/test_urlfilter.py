import random
import re

from dhwani.llm import urlfilter

UP, LOW = urlfilter.UPPER, urlfilter.LOWER


def judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(UP, LOW)), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if host and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def test_against_brute_force(spark, rows):
    r = random.Random(2)
    name = lambda: ".".join(r.choice(["a", "b", "com", "x-y", "net"]) for _ in range(r.randrange(1, 5)))
    path = lambda: "".join(r.choice(["/", "/a", "/b/", ""]) for _ in range(r.randrange(0, 3)))
    rules = sorted({(name(), path()): r.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "http://", "http://COM", "x://a.com?q://b", "http://a.com/b/?c", "http://a://b"]
    urls += [f"http://{name().upper() if r.random() < 0.2 else name()}{path()}{r.choice(['', '?x', '#y'])}" for _ in range(300)]
    pages = rows(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_edges(spark, rows):
    table = urlfilter.rule_table(spark)
    assert urlfilter.judge(rows([], "page_id long, url string"), table).count() == 0
    wide = rows([(1, "http://a.net/es/x", "?"), (1, "http://a.net/es/x", "?"), (None, None, "?")], "page_id long, url string, rule string")
    got = sorted((x.page_id or 0, x.rule or "", x.verdict) for x in urlfilter.judge(wide, table, default="block").collect())
    assert got == [(0, "", "block"), (1, "net/es/", "block"), (1, "net/es/", "block")]
    none = urlfilter.rule_table(spark, [("", "/", "block"), (None, None, "block")])
    assert {x.verdict for x in urlfilter.judge(wide, none).collect()} == {"allow"}
