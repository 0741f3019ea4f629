import itertools
import random

from tidemark.llm import packing as pk
from tidemark.llm import url_rules as ur


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fit, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts, paths = ["org", "a.org", "b.a.org", "com", "x.com", "net", "aorg", "é.com"], ["/", "/a", "/a/", "/a/b", "/ab", "/b", "/a/b/c", "/\U0001f600"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in itertools.product(hosts[:6], paths) if rng.random() < 0.5}.values())
    urls = [None, "", "no scheme", "://", "http://", "http://ORG", "https://b.A.org?x#y", "http://a.org/a?b://c/d", "http://x.com//a", "http://.org/a", "http://org./a", "http://a..org/", "http://x.com/" + "a/" * 5000]
    urls += [f"{rng.choice(['http', 'ftp'])}://{rng.choice(['', 'w.'])}{rng.choice(hosts)}{rng.choice(['', *paths])}{rng.choice(['', 'c', '/b', '?q', '#f'])}" for _ in range(400)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, "http://a.org/a"), (3, "http://a.org/a"), (None, "http://org/")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    for salts in (1, 3):
        got = [tuple(r) for r in ur.url_verdicts(pages, given, salts=salts).collect()]
        assert sorted(map(str, got)) == sorted(str((i, *brute(u, rules))) for i, u in rows)
    assert ur.url_verdicts(pages.limit(0), given).count() == 0
    assert {r.verdict for r in ur.url_verdicts(pages, given.limit(0)).collect()} == {"allow"}
    plan = ur.url_verdicts(pages, given)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)
        ends = pk.best_boundaries(lengths, counts, k)
        least = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        assert len(ends) <= k and ends[-1] == lengths[-1] and padding(lengths, counts, ends) == least
    assert pk.best_boundaries([], [], 4) == []


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1, 5, rng.randint(0, 300), 5000]), "s") for i in range(2000)] + [(7, 5, "s"), (7, 5, "s"), (None, 3, "s")]
    got = pk.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, bucket string"), buckets=5, budget=1000, shard_rows=200).collect()
    assert len(got) == len(rows) and len({r.boundary for r in got}) <= 5
    batches = {}
    for r in got:
        assert r.n_tokens <= r.boundary and r.padding == r.boundary - r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    for rows_ in batches.values():
        assert sorted(r.position for r in rows_) == list(range(len(rows_))) and len({r.bucket for r in rows_}) == 1
        assert len(rows_) * rows_[0].boundary <= max(1000, rows_[0].boundary)
    assert pk.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_one_long_text_does_not_coarsen_the_others(spark):
    lengths = [x for x in range(1, 60) for _ in range(x % 7 + 1)] + [10_000_000]
    got = pk.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), buckets=3).collect()
    distinct = sorted(set(lengths))
    counts = [lengths.count(x) for x in distinct]
    least = min(padding(distinct, counts, [*c, distinct[-1]]) for m in range(3) for c in itertools.combinations(distinct[:-1], m))
    assert sum(r.padding for r in got) == least and max(r.boundary for r in got) == 10_000_000
