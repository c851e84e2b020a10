import datetime
import random

from corpusloom.llm import urlfilter

DAY = datetime.timedelta(days=1)
T0 = datetime.datetime(2024, 1, 1)
CAPTURES, ENTRIES = "page_id long, url string, fetched timestamp", "key string, action string, category string, since timestamp"


def brute(captures, entries):
    out = set()
    for i, url, t in captures:
        keys = []
        if url and "://" in url and t is not None:
            rest = url.lower().partition("://")[2]
            rest = rest.partition("#")[0].partition("?")[0]
            host, _, path = rest.partition("/")
            host = host.rpartition("@")[2].partition(":")[0]
            labels = host.split(".")
            keys = [".".join(labels[k:]) for k in range(len(labels))]
            parts = [p for p in path.split("/") if p]
            keys += [host + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)]
        best = None
        for key in keys:
            held = [(s, a, c) for k, a, c, s in entries if k is not None and a is not None and s is not None and k.lower() == key and s <= t]
            if held:
                last = max(s for s, *_ in held)
                action, category = min((a, c) for s, a, c in held if s == last)
                if action != "remove" and (best is None or len(key) > len(best[1])):
                    best = (action, key, category)
        out.add((i, url, t, *(best or ("none", None, None))))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.b.org", "b.org", "c.net", "x.c.net"]
    entries = [(r.choice([*hosts, "org", "a.b.org/x", "c.net/x/y", "C.NET/z"]), r.choice(["allow", "block", "remove"]), f"c{r.randrange(3)}", T0 + r.randrange(20) * DAY) for _ in range(60)]
    captures = [(i, f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'u@'])}{r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(['', '/', '/x', '/x/y/?q=/z', '/z#x', '//X//y'])}", T0 + r.randrange(-2, 22) * DAY) for i in range(400)]
    got = urlfilter.judged(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert {tuple(x) for x in got} == brute(captures, entries) and len(got) == len(set(captures))


def test_odd_rows(spark):
    entries = [(None, "block", "c", T0), ("a.org", None, "c", T0), ("a.org", "block", None, None), ("b.org", "block", None, T0), ("b.org", "allow", "t", T0)]
    captures = [(None, "http://b.org", T0), (1, None, T0), (2, "no address", T0), (3, "http://a.org/", T0), (4, "http://b.org", None), (3, "http://a.org/", T0), (5, "http://b.org/" + "x/" * 3000, T0), (6, "", T0)]
    df = spark.createDataFrame(captures, CAPTURES).selectExpr("*", "'x' AS key", "'x' AS k", "'x' AS start", "'x' AS action")
    got = {(r["page_id"], r["decision"], r["category"]) for r in urlfilter.judged(df, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {(None, "allow", "t"), (1, "none", None), (2, "none", None), (3, "none", None), (4, "none", None), (5, "allow", "t"), (6, "none", None)}


def test_empty(spark):
    none, some = spark.createDataFrame([], ENTRIES), spark.createDataFrame([(1, "http://a.org", T0)], CAPTURES)
    assert [r["decision"] for r in urlfilter.judged(some, none).collect()] == ["none"]
    assert urlfilter.judged(spark.createDataFrame([], CAPTURES), none).collect() == []
