import numpy as np
import pytest

from windrow.llm import ann
from windrow.llm.ann import BLOCK_ROWS, Forest, nearest
from windrow.llm.common import table
from windrow.llm.url_filter import RULES, judge, propagate


def brute(rows, every=50, k=5):
    out = []
    for q, a in rows:
        if q % every == 0:
            near = sorted((-float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in rows if i != q and len(b) == len(a))
            out.append((q, near[:k]))
    return out


def test_recall(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        frame = table(spark, sf, "embeddings")
        rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect()]
        found: dict[int, list] = {}
        for r in nearest(frame).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = total = 0
        for q, near in brute(rows):
            assert [r for r, _, _ in found[q]] == [1, 2, 3, 4, 5]
            exact = {i: -s for s, i in near}
            hits += sum(i in exact for _, i, _ in found[q])
            total += len(near)
            assert all(abs(s - exact[i]) < 1e-12 for _, i, s in found[q] if i in exact)
        assert hits >= 0.9 * total


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [2.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 1.0]), (100, [0.0, 0.0]), (150, None), (200, [nan, 1.0]),
        (250, [1.0, None]), (300, [float("inf"), 1.0]), (350, []), (None, [1.0, 0.0]), (400, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, label int, score double")
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(frame).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 3), (0, 2, 7), (0, 3, 50), (0, 4, 9), (50, 1, 0), (50, 2, 3), (50, 3, 7), (50, 4, 9)]
    assert nearest(frame.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [1.0, 2.0, float(i)]) for i in range(20)]
    found = [(r["query_id"], r["vec_id"]) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("query_id = 0").orderBy("rank").collect()]
    assert found == [(0, i) for i in (1, 2, 3, 4, 5)]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("spread", "most"), [(0.3, 0.02), (0.8, 0.1), (None, 0.5)])
def test_recall_and_work_of_a_whole_block(spread, most):
    """65,536 rows: clusters are searched by long prefixes, and even directions without structure not by all rows."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((BLOCK_ROWS, 64))
    if spread:
        x = draw.standard_normal((300, 64))[draw.integers(0, 300, BLOCK_ROWS)] + spread * x
    x = unit(x)
    asked = np.arange(0, BLOCK_ROWS, 400)
    cosine = x[asked] @ x.T
    cosine[np.arange(len(asked)), asked] = -2
    true = np.argsort(-cosine, axis=1)[:, :5]
    sampled = cosine[:, draw.permutation(BLOCK_ROWS)[:16_384]]
    bound = np.partition(sampled, -5, axis=1)[:, -5] - 1e-9
    hits = scanned = 0
    for q, found, _ in Forest(x).search(x[asked], bound, 5):
        hits, scanned = hits + np.isin(true[q], found).sum(), scanned + len(found)
    assert hits >= 0.93 * 5 * len(asked) and scanned <= most * len(asked) * BLOCK_ROWS


def test_without_a_bound_everything_is_searched():
    x = unit(np.random.default_rng(0).standard_normal((500, 8)))
    assert all(len(found) == 500 for _, found, _ in Forest(x, trees=4).search(x[:20], np.full(20, -2.0), 600))


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1.1e-200]), (2, [-1e300, 1.0]), (3, [3e-308, 0.0]), (4, [1.0, 2.0]), (50, [1e-320, 1e-320])]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 50), (0, 1), (0, 4), (50, 0), (50, 1), (50, 4)]
    assert [round(r["score"], 6) for r in found] == [1.0, 0.998868, 0.948683] * 2


def test_several_vectors_of_an_id_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0], 1, 1.0, 1, 1), (7, [0.0, 1.0], 2, 1.0, 1, 1), (7, [1.0, 0.1], 2, 1.0, 1, 1), (8, [1.0, 1.0], 2, 1.0, 1, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, bound double, part int, vector int")
    assert [(r["rank"], r["vec_id"]) for r in nearest(frame).orderBy("rank").collect()] == [(1, 7), (2, 8)]


def brute_rule(url):
    host = path = ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for _, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    "http://a.COM/en/x", "https://example.com/en/7?x#y", "https://m.example.com/en/71", "http://notexample.com/en/7", "http://com/en/", "http://x.net/de/", "http://example.net/de/8", "http://example.net/de/9",
    "x.org/es/", "http://É.ORG/es/1", None, "", "http://", "://a.org/es/?", "http://a.org?x/es/", "http://a.org#/es/", "ftp://a://b.org/es/", "http://a\nb.org/es/\n", "http://example.com/fr/1",
]


def test_rules(spark):
    frame = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(URLS)] + [(1, URLS[1], "", "x", "y")], "page_id long, url string, html string, host string, rule string")
    found = judge(frame).collect()
    verdicts = dict((r, v) for v, r in RULES)
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path, rule = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == verdicts[rule])
        assert host or r["verdict"] == "allow"
    assert judge(frame.limit(0)).count() == 0


def test_verdicts_of_the_contract(spark):
    """Every rule's word as the contract has it, spelled out here, on its host and a subdomain, and where a longer rule overrules it."""
    rows = [
        ("http://com/en/1", "com/en/", "block"), ("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/6", "com/en/", "block"),
        ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://m.example.com/en/71", "example.com/en/7", "allow"),
        ("http://net/de/1", "net/de/", "allow"), ("http://a.net/de/1", "net/de/", "allow"), ("http://example.net/de/9", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net/de/8", "block"), ("http://m.example.net/de/81", "example.net/de/8", "block"),
        ("http://org/es/1", "org/es/", "block"), ("http://a.org/es/1", "org/es/", "block"),
    ]
    found = judge(spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(rows)], "page_id long, url string, html string"))
    assert [(r["rule"], r["verdict"]) for r in found.orderBy("page_id").collect()] == [(rule, verdict) for _, rule, verdict in rows]


def test_pages_table(spark, sf):
    frame = table(spark, sf, "pages")
    urls = {r["page_id"]: r["url"] for r in frame.collect()}
    assert all((r["host"], r["path"], r["rule"]) == brute_rule(urls[r["page_id"]]) for r in judge(frame).collect())


def test_links_carry_distrust_back_and_trust_on(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a class="x" href="{u}">' for u in links))
    rows = [
        page(1, "http://bad.com/en/1"), page(2, "http://bad.com/en/2"), page(3, "http://friend.info/1", "http://bad.com/en/1", "//bad.com/x"), page(4, "http://example.com/en/7"),
        page(5, "http://news.info/1", "http://bad.com/en/1"), page(6, "http://other.info/", "/relative", "http://other.info/x"),
        *(page(10 + i, "http://example.com/en/7", "https://news.info/1") for i in range(5)),
    ]
    found = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (found[1], found[3], found[4], found[6]) == ("block", "block", "allow", "allow")


@pytest.mark.parametrize("links", [[("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("d", "a", 1), ("c", "e", 3)], [("a", "b", 1)], []])
def test_ranks(spark, links):
    seeds = {"a": (1.0, 0.0), "c": (0.0, 0.5), "z": (0.2, 0.1)}
    got = propagate(
        spark.createDataFrame([(h, t, d) for h, (t, d) in seeds.items()], "host string, trusted double, distrusted double"),
        spark.createDataFrame(links, "source string, target string, pages long"),
    )
    hosts = sorted({*seeds, *(x for s, t, _ in links for x in (s, t))})
    rank = {h: [0.15 * x for x in seeds.get(h, (0.0, 0.0))] for h in hosts}
    start = {h: list(v) for h, v in rank.items()}
    for _ in range(200):
        new = {h: list(v) for h, v in start.items()}
        for s, t, w in links:
            new[t][0] += 0.85 * rank[s][0] * w / sum(x for a, _, x in links if a == s)
            new[s][1] += 0.85 * rank[t][1] * w / sum(x for _, b, x in links if b == t)
        rank = new
    got = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    assert set(got) == set(rank) and all(got[h] == pytest.approx(rank[h], rel=0.005, abs=1e-12) for h in rank)


def test_ranks_reach_hosts_that_are_far_away(spark):
    """Distrust follows a chain of 30 links back, one link each round, and trust comes from the near side."""
    names = [f"h{i:02}" for i in range(31)]
    hosts = spark.createDataFrame([("h30", 0.0, 1.0)], "host string, trusted double, distrusted double")
    links = spark.createDataFrame([(a, b, 1) for a, b in zip(names, names[1:])], "source string, target string, pages long")
    got = {r["host"]: r["distrust"] for r in propagate(hosts, links).collect()}
    assert all(got[h] == pytest.approx(0.15 * 0.85 ** (30 - i), rel=1e-6) for i, h in enumerate(names))


def test_long_vectors_come_in_smaller_blocks(spark, monkeypatch):
    """What a task holds is bounded by components, too; rows in many blocks and queries in many parts are found all the same."""
    monkeypatch.setattr(ann, "BLOCK_NUMBERS", 64 * 128)
    draw = np.random.default_rng(5)
    x = draw.standard_normal((1500, 64))
    rows = [(i, v) for i, v in enumerate(x)]
    found: dict[int, list] = {}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    for r in nearest(frame, every=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(found[q]) & {i for _, i in near}) for q, near in brute(rows, every=5))
    assert len(found) == 300 and all(len(f) == 5 for f in found.values()) and hits >= 0.9 * 1500
