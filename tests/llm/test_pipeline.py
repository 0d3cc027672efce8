import hashlib
import itertools
import re
from collections import Counter

import duckdb
import public_tokenizers
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from windrow.llm.common import materialise, table
from windrow.llm.language_id import LEAST_SCORE, identify
from windrow.llm.queries import MODEL, ORACLE, QUERIES


def brute_targets(sizes):
    """Targets by giving out what is left, again and again, to the sources that are below twice their size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, below, target = 1.5 * sum(sizes.values()), set(order), {}
    while below:
        rate = left / sum(weight[s] for s in below)
        if not (over := {s for s in below if rate * weight[s] > 2 * sizes[s]}):
            return target | {s: rate * weight[s] for s in below}
        target |= {s: 2.0 * sizes[s] for s in over}
        left, below = left - sum(2 * sizes[s] for s in over), below - over
    return target


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        kept.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert kept[1] <= kept[0] and kept[2] < kept[1] and kept[3] <= kept[2] and kept[5] == kept[4] > kept[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def near_components(docs):
    """The smallest doc_id that links reach, by comparing all pairs."""
    sets = {d["doc_id"]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for d in docs for w in [words(d["text"])]}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}


def test_pipeline_against_brute_force(spark, sf):
    """Each stage against a plain version of its own, on what the stage before it kept."""
    stages, frame = dict(corpus_pipeline.STAGES), table(spark, sf, "documents")

    def stage(name):
        nonlocal frame
        before = [r.asDict() for r in frame.collect()]
        frame = materialise(stages[name](spark, frame, sf), name)
        return before, [r.asDict() for r in frame.collect()]

    told = {r["doc_id"] for r in identify(frame).collect() if r["lang_pred"] != "und" and r["score"] >= LEAST_SCORE}
    before, after = stage("language")
    assert {d["doc_id"] for d in after} == told and len(after) == sum(d["doc_id"] in told for d in before)
    before, after = stage("exact")
    first: dict[str, int] = {}
    for d in sorted(before, key=lambda d: d["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d["text"] or ""), d["doc_id"])
    assert sorted(d["doc_id"] for d in after) == sorted(first.values())
    before, after = stage("near")
    assert sorted(d["doc_id"] for d in after) == sorted({*near_components(before).values()})
    before, after = stage("mixture")
    copies, whole = Counter(d["doc_id"] for d in after), Counter()
    for d in before:
        whole[d["source"]] += len(words(d["text"]))
    targets = brute_targets(whole)
    for s in whole:
        own = [d for d in before if d["source"] == s]
        got, longest = sum(copies[d["doc_id"]] * len(words(d["text"])) for d in own), max(len(words(d["text"])) for d in own)
        assert abs(got - targets[s]) <= 1.05 * longest + 1 and all(copies[d["doc_id"]] <= 2 for d in own), s
    assert {tuple(d.values()) for d in after} <= {tuple(d.values()) for d in before}
    before, after = stage("tokens")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d["doc_id"], len(ids := model.encode(d["text"])), digest(",".join(map(str, ids))), digest(model.decode(ids))) for d in before]
    assert sorted(tuple(d.values()) for d in after) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_stages_with_clashing_columns(spark, sf):
    """Columns named like those that the operators make for themselves come through every filtering stage."""
    names = ("row", "key", "digest", "found", "keep_id", "size", "mark", "copies", "rows", "name", "kept", "c", "lang_pred", "score", "ids")
    docs = table(spark, sf, "documents").filter("doc_id < 60")
    plain, more = docs, docs.selectExpr("*", *(f"{i} as `{n}`" for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:3]:
        plain, more = (materialise(stage(spark, d, sf), name) for d in (plain, more))
        assert more.columns == [*docs.columns, *names] and sorted(r["doc_id"] for r in more.collect()) == sorted(r["doc_id"] for r in plain.collect())
    mixed = materialise(corpus_pipeline.mixture(spark, more, sf), "mixture")
    assert mixed.columns == more.columns and corpus_pipeline.tokens(spark, mixed, sf).count() == mixed.count() > 0


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "Some text here", "en", None, 1), (2, "Some  text\there", None, "", 1), (None, None, None, None, None), (3, "12 34", "de", "b", 1), (None, "w " * 30_000, "en", "b", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_is_registered():
    names = entry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names


def test_sql(spark, sf):
    for name, sql in ORACLE.items():
        connection = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "labels"):
            connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        result = connection.execute(sql)
        columns = [d[0] for d in result.description]
        got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).select(*columns).collect()]
        assert sorted(got, key=repr) == sorted(result.fetchall(), key=repr), name


def test_mix_against_sql_where_blocks_are_dealt_again(spark):
    """At this size some sources' pieces lose whole blocks beyond twice their words."""
    sf = "/root/testdata/sf0.1"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(connection.execute(f"select {', '.join(columns)} from ({ORACLE['op5_mix_sources']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op5_mix_sources"](spark, sf).select(*columns).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
