import random

from quercus.llm import url_filter as u


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", p, h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[5] if best else default


def test_brute_force(spark):
    rnd = random.Random(1)
    labels = ["com", "example", "www", "net", "a", "b-c", "éx", "", "com2", "xn--a"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 5)))
    path = lambda: rnd.choice(["", "/", "/en", "/en/", "/en/x", "/es/y\nz", "/fr/"])
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(40))}.values())
    urls = [None, "", "no scheme", "://", "http://", "x://y://z/", "http://COM/En/", "HTTP://www.Example.com/en/1?x=/a#b", "http://com?a/b", "http://a.com:80/", "http://É.com/"]
    urls += [f"http://{host()}{path()}{rnd.choice(['', '?q=/en/', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i if i != 7 else None, x, 0, "v") for i, x in enumerate(urls)] + [(3, urls[3], 0, "v")], "page_id long, url string, part int, verdict string")
    for own in (u.RULES, rules, []):
        frame = spark.createDataFrame(own, "verdict string, host string, path string")
        got = sorted(map(tuple, u.filter_urls(pages, frame).collect()), key=str)
        want = [(i if i != 7 else None, *brute(x, own)) for i, x in enumerate(urls)] + [(3, *brute(urls[3], own))]
        assert got == sorted(want, key=str)
    assert u.filter_urls(pages.limit(0), u.rules_frame(spark)).count() == 0
