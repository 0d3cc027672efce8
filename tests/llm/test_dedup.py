import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windrow.llm import near_dedup
from windrow.llm.common import table
from windrow.llm.components import components
from windrow.llm.exact_dedup import exact_groups, heavy_digests, keep_first_copies
from windrow.llm.near_dedup import keep_one_of_near_copies, near_groups, set_name, shingle_sets

SCHEMA = "doc_id long, text string, source string, n long, name string, digest string, keep_id string, c string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "n", "d", "k", "c") for i, t in rows], SCHEMA)


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (None, "a\n\x0bb"), (1, ""), (2, None), (4, " "), (6, "\u00a0"), (7, "x" * 200_000), (8, "x" * 200_000), (3, "a\tb"), (None, "lone"), (None, "lone")]


@pytest.mark.parametrize("support", [0.001, 0.2, 0.5])
def test_exact_groups(spark, support):
    got = sorted((tuple(r) for r in exact_groups(documents(spark, ODD), support).collect()), key=repr)
    assert got == brute_exact(ODD)


def test_exact_copies_that_most_rows_are(spark):
    rows = [(i, "copy" if i % 3 else f"text {i % 400}") for i in range(3000)]
    docs = documents(spark, rows).repartition(7)
    assert sorted((tuple(r) for r in exact_groups(docs, 0.01).collect()), key=repr) == brute_exact(rows)
    kept = keep_first_copies(docs, 0.01)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k, *_ in brute_exact(rows) if i == k) and kept.columns == docs.columns
    digests = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    assert [r["group_size"] for r in heavy_digests(digests, 0.1).collect()] == [2000]


def test_exact_on_nothing_and_on_the_table(spark, sf):
    assert exact_groups(documents(spark, [])).count() == 0 and keep_first_copies(documents(spark, [])).count() == 0
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in exact_groups(docs).collect()), key=repr) == brute_exact(rows)
    assert keep_first_copies(docs).count() == sum(k for _, _, _, k, _ in brute_exact(rows))


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows):
    """(n_shingles, component) per row, by comparing all pairs; rows without an id are named by their place."""
    sets = [word_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(i, len(sets[k]), i if not sets[k] else min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows)]


def check_near(spark, rows, parts=3):
    got = near_groups(documents(spark, rows).repartition(parts)).collect()
    want = [(i, n, c, i == c) for i, n, c in brute_near(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_near_odd_rows(spark):
    check_near(spark, [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "a b c d e"), (8, "A B C D E"), (None, "a b c d e"), (None, "z y x w v u"), (None, None), (9, "É b c d e"), (10, "é b c d e"), (7, "a b c d e")])
    assert near_groups(documents(spark, [])).count() == 0 and keep_one_of_near_copies(documents(spark, [])).count() == 0


def variants(draw, base, count, edits, words):
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(len(own))] = draw.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_all_degrees(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    passage = text(60)
    rows = [" ".join(text(draw.randint(1, 40))) for _ in range(60)]
    for n in (12, 60, 150, 400):
        rows += variants(draw, text(n), 12, n // 12, words)
    rows += [" ".join([*text(draw.randint(3, 40)), *passage, *text(draw.randint(3, 40))]) for _ in range(60)]
    rows += [" ".join(text(8000))] * 2
    draw.shuffle(rows)
    check_near(spark, list(enumerate(rows)))


@pytest.mark.parametrize("rounds", [1, 2])
def test_long_lists_lose_no_link(spark, monkeypatch, rounds):
    """Lists are long from nine members on, so leaders and bounds decide nearly everything."""
    monkeypatch.setattr(near_dedup, "LIST", 8)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    base, other, line = text(110), text(110), text(9)
    rows = variants(draw, base, 60, 5, words) + variants(draw, other, 40, 5, words)
    rows += variants(draw, base[:60] + other[:50], 30, 4, words) + variants(draw, base + line, 30, 5, words)
    rows += [" ".join([*base, *text(draw.randint(5, 60))]) for _ in range(30)]
    draw.shuffle(rows)
    check_near(spark, list(enumerate(rows)))


def test_near_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_near(spark, rows)
    kept = keep_one_of_near_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute_near(rows) if i == c) and kept.columns == docs.columns


def test_sets():
    texts = ["a b c d e f", "A B C D E F", "a b c d e", None, "", "a b", "b a", "e d c b a x y z " * 50]
    found = list(shingle_sets(texts))
    assert [len(v) for v in found] == [len(word_set(t)) for t in texts]
    assert np.array_equal(found[0], found[1]) and set(found[2]) <= set(found[0]) and found[5] != found[6]
    names = [set_name(v) for v in found]
    assert names[3] is None and names[0] == names[1] and len({n for n in names if n}) == 5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, links):
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(14):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


def test_components_of_a_path(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in components(links).collect()} == {0}


def test_words_that_agree_under_polynomials_of_powers_of_two(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a  # the words of Thue and Morse
    around = "one two three four five six seven eight nine"
    texts = [f"{around} {w} {around}" for w in (a, b, a)]
    for seed in (0, 1):
        sets = [set(v.tolist()) for v in shingle_sets(texts, seed)]
        assert sets[0] == sets[2] and len(sets[0] - sets[1]) == 5 == len(sets[1] - sets[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()} == {0: 0, 1: 1, 2: 0}


def test_hashes_of_long_texts_do_not_depend_on_their_place():
    words = [f"w{i}" for i in range(120_000)]
    long, short = " ".join(words), " ".join(words[-2000:])
    assert len(long) > 1 << 19
    for seed in (0, 1):
        whole, end = (set(v.tolist()) for v in shingle_sets([long, short], seed))
        assert len(whole) == 120_000 - 4 and len(end - whole) == 0


def test_without_broadcasts(spark, sf, monkeypatch):
    """Beyond the counted bound of a broadcast the same rows come out of shuffled joins."""
    from windrow.llm import exact_dedup, mixing

    docs = table(spark, sf, "documents")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    runs = (exact_groups, keep_first_copies, near_groups, keep_one_of_near_copies, mixing.mix, mixing.mix_rows)
    before = [rows(run(docs)) for run in runs]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for module in (exact_dedup, mixing, near_dedup):
            monkeypatch.setattr(module, "BROADCAST", 0)
        assert [rows(run(docs)) for run in runs] == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_small_graphs_are_written_by_few_tasks(spark):
    """However many shuffle partitions there are, a few links don't become a file for each of them."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components(spark.range(900).selectExpr("id + 1 as u", "id - id % 3 as v"))
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {r["root"] for r in found.collect()} == {0} and found.count() == 901
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_written_on_the_way_are_deleted(spark, sf):
    from pathlib import Path

    from windrow.llm.common import shared_dir

    top = Path(shared_dir(spark).removeprefix("file://")) / "windrow"
    before = set(top.rglob("*.parquet")) if top.exists() else set()
    found = near_groups(table(spark, sf, "documents"))
    left = {f.parent.name for f in set(top.rglob("*.parquet")) - before}
    assert left == {"sketches", "components"} and found.count() > 0
