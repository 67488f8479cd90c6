import random

from seqloom.llm import urls


def test_as_of(spark):
    rnd = random.Random(3)
    names = ["a.com", "b.a.com", "c.b.a.com", "com", "x.org", "xa.com"]
    entries = [(rnd.choice("pq"), rnd.choice(names), rnd.choice(["add", "remove"]), rnd.randint(0, 20)) for _ in range(60)]
    entries += [("p", None, "add", 1), ("p", "x.org", "add", None), entries[0]]
    hosts = [*names, "www.x.org", "other.net"]
    captures = [(i, f"http://U:p@{rnd.choice(hosts).upper()}:80/x?http://a.com", rnd.randint(0, 22), 9) for i in range(120)]
    captures += [(500, None, 3, 9), (501, "no url", 3, 9), (502, "http://a.com/", None, 9), captures[0]]
    got = urls.filter_urls(
        spark.createDataFrame(captures, "page_id long, url string, fetched long, domain int"), spark.createDataFrame(entries, "list string, domain string, action string, since long")
    ).collect()
    assert len(got) == len(captures)

    def active(host, at):
        n, best = 0, None
        for key in {(e[0], e[1]) for e in entries if e[1] and e[3] is not None}:
            if host and at is not None and (host == key[1] or host.endswith("." + key[1])):
                past = sorted((e[3], e[2]) for e in entries if (e[0], e[1]) == key and e[3] is not None and e[3] <= at)
                if past and past[-1][1] == "add":
                    n, best = n + 1, max(best or "", key[1], key=len)
        return n, best

    want = sorted((i, *active(u.split("@")[1].split(":")[0].lower() if u and "@" in u else ("a.com" if u and "//" in u else None), t)) for i, u, t, _ in captures)
    assert sorted((r.page_id, r.n_active, r.listed_as) for r in got) == sorted(want)
    assert all(r.blocked == (r.n_active > 0) for r in got)


def test_only_listed_depths_travel(spark):
    c = spark.createDataFrame([(1, "http://a.b.example.com/x", 5), (2, "http://com", 5), (3, "http://x.org", 5), (4, None, 5), (5, "http://" + "a." * 300 + "org/" + "y" * 50_000, 5)], "page_id long, url string, fetched long")
    e = spark.createDataFrame([("l", "com", "add", 1), ("l", "b.example.com", "add", 2)], "list string, domain string, action string, since long")
    got = {r.page_id: (r.n_active, r.listed_as, r.blocked) for r in urls.filter_urls(c, e).collect()}
    assert got == {1: (2, "b.example.com", True), 2: (1, "com", True), 3: (0, None, False), 4: (0, None, False), 5: (0, None, False)}
    assert {r.blocked for r in urls.filter_urls(c, e.limit(0)).collect()} == {False}
    from pyspark.sql import functions as F

    assert spark.range(1).select(urls.domains(F.lit("a.b.c"), [2, 5])).first()[0] == ["b.c"]
