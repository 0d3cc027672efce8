import hashlib
import heapq
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from windrow.llm import language_id, mixing, pii, toxicity
from windrow.llm.common import table
from windrow.llm.mixing import TURNS, apportion, mix, mix_rows
from windrow.llm.queries import MODEL
from windrow.llm.sentencepiece_bpe import PrefixTable, decode_ids, encode_texts, model_bytes, tokenised

PATH = public_tokenizers.path(MODEL)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + more)


# SentencePiece


def odd_texts():
    draw = random.Random(3)
    chars = "aeiourstnl  ▁\n\t.,:éñ日本語한😀\x00\x7f\u0301(){};_=<>0x1230123ABCthe"
    out = ["", " ", "a", "▁", "<s>", "<0x41>", "\x00", "é" * 50, " " * 100 + "x", "a" * 3000, "the " * 3000]
    out += ["".join(draw.choice(chars) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    return out + [" " * k + x for k in range(50) for x in ("", "a", "é", "一", "😀")]


def test_ids_and_texts_are_the_library_s(spark, sf):
    model, own = sentencepiece.SentencePieceProcessor(model_file=PATH), PrefixTable(model_bytes(PATH))
    texts = odd_texts() + [r["text"] for r in table(spark, sf, "documents").collect()] + [own.piece[i] for i in own.piece]
    for text in texts:
        ids = model.encode(text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == model.decode(ids)
        assert own.summary(text) == (len(ids), ",".join(map(str, ids)), model.decode(ids))


def test_decoding_any_ids():
    model, own = sentencepiece.SentencePieceProcessor(model_file=PATH), PrefixTable(model_bytes(PATH))
    draw = random.Random(4)
    bytes_ = [i for i in range(3, 259)]
    for _ in range(500):
        ids = [draw.choice(bytes_ if draw.random() < 0.6 else range(259, 32000)) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == model.decode(ids), ids


def test_tokenised(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "Hello  world\n", None, None), (3, "Hello  world\n", None, None), (None, "x" * 100_000, "en", "s")]
    found = tokenised(docs(spark, [(*r, 9, "i") for r in rows], ", n_tokens int, ids string"), PATH).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := model.encode(t or "")), digest(",".join(map(str, ids))), digest(model.decode(ids))) for i, t, *_ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert tokenised(docs(spark, []), PATH).count() == 0
    back = decode_ids(encode_texts(docs(spark, rows), PATH), PATH).collect()
    assert Counter(r["text"] for r in back) == Counter(t or "" for _, t, *_ in rows)


# Personal data


def test_patterns():
    draw = random.Random(2)
    for _ in range(5000):
        text = "".join(draw.choice("a1@.+-(9 )b5%_") for _ in range(draw.randint(0, 30)))
        assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)], text
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text
    for _ in range(3000):
        text = "".join(draw.choice("0123456789 -+().x") if draw.random() < 0.4 else draw.choice("0123456789") for _ in range(draw.randint(0, 60)))
        cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        phones = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert pii.base_spans(text)[2:] == [cards, phones], text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    spans = pii.base_spans("ü a@b.c 1.2.3.256 0255.1.1.001, 4111-1111 11111111 +1 (415) 555-2671 +12345")
    assert spans == [[(2, 7)], [(18, 30)], [(32, 50)], [(51, 68)]]


def test_very_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 100_000, "x1 " * 50_000):
        base = pii.base_spans(text)
        pii.added_spans([text], [base], pii.trained())


def test_the_field_adds_to_the_patterns(spark):
    text = "please call 555-7713 or (030) 555-0199, write to jane.doe(at)example.org, the card 3782 822463 10005 was used in 2024 on page 12, mail a.b@c.de"
    r = pii.find_pii(docs(spark, [(1, text, "en", "s"), (2, None, None, None), (2, "", None, None), (None, "x@y.z " * 20_000, "", "")])).collect()
    by = {x["doc_id"]: x for x in r}
    found = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in by[1]["spans"].split(",")]
    assert found == [("email", "jane.doe(at)example.org"), ("email", "a.b@c.de"), ("card", "3782 822463 10005"), ("phone", "555-7713"), ("phone", "(030) 555-0199")]
    a = text.index("a.b@c.de")
    assert by[1]["n_email"] == 1 and by[1]["base_sha256"] == hashlib.sha256(f"email:{a}:{a + 8}".encode()).hexdigest()
    assert by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[None]["n_email"] == 20_000
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_the_field_learns_its_table():
    field = pii.trained()
    for words, truth in pii.labelled():
        text = " ".join(words)
        found = pii.added_spans([text], [[[], [], [], []]], field)[0]
        assert sum(map(len, found)) == sum(pii.LABELS[x].startswith("B") for x in truth), text


def generated(draw):
    """(text, added spans' texts by kind) of sentences that aren't in the labelled table."""
    digit = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghijklmnoprstuvwyz") for _ in range(draw.randint(2, 9)))
    hexed = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))

    def card(n):
        body = "34"[draw.randint(0, 1)] + digit(n - 2)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    top = draw.choice(["com", "org", "net", "de"])
    kind, span = draw.choice([
        ("phone", lambda: f"555-{digit(4)}"), ("phone", lambda: f"({digit(3)}) 555-{digit(4)}"), ("phone", lambda: f"{digit(3)}-555-{digit(4)}"),
        ("email", lambda: f"{word()}.{word()}(at){word()}.{top}"), ("email", lambda: f"{word()}[at]{word()}.{top}"), ("email", lambda: f"{word()} at {word()} dot {top}"),
        ("card", lambda: card(15)), ("card", lambda: f"{(c := card(15))[:4]} {c[4:10]} {c[10:]}"),
        ("secret", lambda: "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))), ("secret", lambda: hexed(18)), ("secret", lambda: hexed(40)),
        ("none", lambda: draw.choice([f"in {draw.randint(1500, 2100)}", f"page {draw.randint(1, 900)}", f"version {digit(1)}.{digit(1)}", f"{digit(1)}.{digit(2)} kg", f"{draw.randint(1, 28):02}.{draw.randint(1, 12):02}.2023", f"{draw.randint(10, 23)}:{draw.randint(10, 59)}"])),
    ])
    found = span()
    around = {18: f"password={found}", 40: f'token = "{found}"'}.get(len(found), found) if kind == "secret" and not found.startswith("AKIA") else found
    text = " ".join([*(word() for _ in range(draw.randint(1, 6))), around, *(word() for _ in range(draw.randint(1, 6)))])
    return text, kind, found


def test_what_the_field_finds_in_texts_it_was_not_trained_on():
    draw, field = random.Random(77), pii.trained()
    right, wanted, given = Counter(), Counter(), Counter()
    for _ in range(1200):
        text, kind, found = generated(draw)
        got = [(k, text[a:b]) for k, own in zip(pii.ALL_KINDS, pii.added_spans([text], [pii.base_spans(text)], field)[0], strict=True) for a, b in own]
        if kind != "none" and any(text[a:b] == found for own in pii.base_spans(text) for a, b in own):
            continue
        wanted[kind] += kind != "none"
        for k, span in got:
            given[k] += 1
            right[k] += (k, span) == (kind, found)
    assert sum(right.values()) >= 0.95 * sum(given.values())
    assert all(right[k] >= 0.8 * wanted[k] for k in ("email", "card", "phone", "secret")), (right, wanted, given)


def test_words_are_read_to_their_end():
    field = pii.trained()
    for text in (f"write to {'jane' * 40}(at)example.org now", f"write to {'jane.doe-' * 12}x(at){'mail.' * 30}example.org now"):
        (a, b), = pii.added_spans([text], [pii.base_spans(text)], field)[0][0]
        assert text[a:b] == text.split(" ")[2]
    assert pii.features("9" * 500 + "a") != pii.features("9" * 500 + "(at)a") and pii.shape("ab" * 100 + "1(at)x") == "a91(a)a"


def test_decoding_is_exact():
    """Viterbi against all labellings."""
    import itertools

    field, draw = pii.trained(), np.random.default_rng(1)
    k = len(pii.LABELS)
    first = np.array([0.0] + [-1e9] * (k - 1))
    moves = field.moves()
    for n in (1, 2, 3):
        unary = draw.standard_normal((5, n, k)) * 5
        got = field.decode(unary, np.full(5, n), np.tile(first, (5, 1)))
        for row in range(5):
            def score(labels, row=row):
                path = (0, *labels, 0)
                return sum(moves[a, b] for a, b in itertools.pairwise(path)) + sum(unary[row, i, x] for i, x in enumerate(labels))

            best = max(itertools.product(range(k), repeat=n), key=score)
            assert tuple(got[row]) == best


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check_mix(spark, rows, parts=1):
    frame = docs(spark, rows).repartition(parts)
    found = mix(frame).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = brute_targets(sizes)
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= TURNS * r["size"]
        source = r["key"][1:] if r["key"] else None
        assert r["source_size"] == sizes[source] and abs(r["target"] - targets[source]) < 1e-6 * max(1, targets[source])
        taken[source] += r["taken"]
    again = mix(frame.repartition(parts + 2)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    return taken, targets


def test_mix(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()]
    taken, targets = check_mix(spark, rows)
    assert all(abs(taken[s] - t) <= 0.02 * t + 64 for s, t in targets.items())


def test_mix_odd_rows(spark):
    check_mix(spark, [(1, None, "en", None), (2, "", "en", ""), (3, "a " * 5000, "en", "é"), (3, "a " * 5000, "en", "é"), (None, "b c", "en", "z"), (4, "x", "en", None)])
    check_mix(spark, [(1, None, None, None), (2, " ", "en", "b")])
    assert mix(docs(spark, [])).count() == 0 and mix_rows(docs(spark, [])).count() == 0


def test_mix_with_clashing_columns(spark):
    rows = [(i, "a b c " * (i % 5), "en", "xyz"[i % 3]) for i in range(60)]
    plain = docs(spark, rows)
    clash = plain.selectExpr("*", "1 as key", "'q' as shard", "9 as taken", "2 as size", "3 as target", "4 as place", "5 as row", "6 as copies", "7 as rows", "8 as mark")
    assert sorted(map(tuple, mix(clash).collect()), key=repr) == sorted(map(tuple, mix(plain).collect()), key=repr)
    assert mix_rows(clash).columns == clash.columns and mix_rows(clash).count() > 0


def test_pii_with_clashing_columns(spark):
    frame = docs(spark, [(1, "a.b@c.de", "en", "s"), (1, "a.b@c.de", "en", "s")]).selectExpr("*", "1 as spans", "2 as n_email", "3 as base_sha256")
    assert [(r["n_email"], r["spans"]) for r in pii.find_pii(frame).collect()] == [(1, "email:0:8")] * 2


def test_mix_rows(spark, sf):
    frame = table(spark, sf, "documents")
    rows = mix_rows(frame)
    assert rows.columns == frame.columns and rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= TURNS
    words = rows.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    whole = frame.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words - 1.5 * whole) < 0.1 * whole


def test_mix_rows_takes_the_blocks_of_sainte_lague(spark):
    """What every document is taken follows from a plain version of the blocks, the shards' quotas and their rings."""
    draw = random.Random(11)
    sized = [(s, f"={s}", draw.randint(40, 260), draw.getrandbits(60), 1) for s, n in (("a", 2500), ("b", 1000), ("c", 500)) for _ in range(n)]
    found = mixing._copies(spark.createDataFrame(sized, "source string, key string, size long, mark long, rows long"))
    copies = {r["mark"]: r["copies"] for r in found.collect()}
    name = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    def dealt(claims, seats):
        won, line = Counter(), [(-c, i) for i, c in claims.items()]
        heapq.heapify(line)
        for _ in range(seats):
            i = line[0][1]
            won[i] += 1
            heapq.heapreplace(line, (-claims[i] / (2 * won[i] + 1), i))
        return won

    whole, pieces = Counter(), {}
    for s, _, n, _, _ in sized:
        whole[s] += n
    shards, targets = -(-sum(whole.values()) // mixing.SHARD_WORDS), brute_targets(whole)
    for s, _, n, mark, _ in sized:
        pieces.setdefault((s, name(f"{mixing.SEED}s{mark}") % shards), []).append((name(f"{mixing.SEED}o{mark}"), mark, n))
    blocks = dealt(targets, round(sum(targets.values()) / mixing.BLOCK))
    assert shards > 3 and len(pieces) == 3 * shards
    for place, s in enumerate("abc", 1):
        words = {shard: sum(n for _, _, n in docs) for (t, shard), docs in pieces.items() if t == s}
        got = 0
        for shard, seats in dealt(words, blocks[s]).items():
            quota, size = seats * mixing.BLOCK, words[shard]
            start = name(f"{mixing.SEED}:{place}:{shard}") % -(-size // mixing.BLOCK) * mixing.BLOCK
            last, at, cut = start + quota % size, 0, 0
            assert quota < 2 * size
            for _, mark, n in sorted(pieces[s, shard]):
                taken = quota // size * n + max(0, min(at + n, last) - max(at, start)) + max(0, min(at + n, last - size) - at)
                assert copies.get(mark, 0) in (taken // n, -(-taken // n)), (s, shard, taken, n)
                got, at, cut = got + n * copies.get(mark, 0), at + n, cut + (taken % n > 0)
            assert cut <= 2
        assert abs(got - targets[s]) <= 260 + 2 * mixing.BLOCK


def test_mix_of_many_small_pieces(spark):
    """A source that stands at twice its words, in 2000 pieces of a few words: none of it is lost."""
    draw = random.Random(9)
    rows = [(i, "w " * draw.randint(1, 60), "en", "a") for i in range(1500)] + [(9000 + i, "w " * 9000, "en", "b") for i in range(20)]
    frame = docs(spark, rows)
    words = Counter()
    for _, text, _, s in rows:
        words[s] += len(text) // 2
    found = mix(frame, shard_words=sum(words.values()) // 2000).collect()
    assert all(0 <= r["taken"] <= TURNS * r["size"] for r in found)
    for s, target in brute_targets(words).items():
        assert abs(sum(r["taken"] for r in found if r["key"] == f"={s}") - target) <= 64, s


def test_mix_rows_meets_every_source_s_target(spark):
    """90 sources of 30 documents each, in a corpus of some 90 shards: about one document of a source in each shard."""
    draw = random.Random(5)
    sizes = [(i, f"s{i % 90:02}", draw.randint(2000, 6800)) for i in range(2700)]
    frame = spark.createDataFrame(sizes, "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    whole, longest = Counter(), Counter()
    for _, s, n in sizes:
        whole[s] += n
        longest[s] = max(longest[s], n)
    got = {r["source"]: r["n"] for r in mix_rows(frame).groupBy("source").agg(F.sum(F.length("text") / 2).alias("n")).collect()}
    for s, target in brute_targets(whole).items():
        assert abs(got[s] - target) <= 1.05 * longest[s], (s, got[s] / target)


def test_mix_rows_equal_rows(spark):
    rows = [(1, "a b c", "en", "s")] * 7 + [(None, "a b c", "en", "s")] * 5 + [(2, "a b", "en", "t"), (3, None, "en", "t")]
    got = Counter(map(tuple, mix_rows(docs(spark, rows)).collect()))
    assert sum(n * len(r[1].split()) for r, n in got.items() if r[3] == "s") in range(51 - 3, 51 + 4)
    assert got[(2, "a b", "en", "t")] == 2 and set(got) <= set(rows) and (3, None, "en", "t") not in got


def test_apportionment_is_sainte_lague(spark):
    draw = random.Random(8)
    for _ in range(6):
        claims = [draw.choice([0, 1, 7, draw.randint(1, 5000)]) for _ in range(draw.randint(1, 9))]
        seats = draw.randint(0, 60)
        if not sum(claims):
            continue
        quotients = sorted(((-c / (2 * k + 1), i) for i, c in enumerate(claims) if c for k in range(seats)))[:seats]
        want = Counter(i for _, i in quotients)
        frame = spark.createDataFrame([(i, float(c), seats) for i, c in enumerate(claims)], "i long, claim double, seats long")
        assert {r["i"]: r["won"] for r in apportion(frame, [], "claim", "seats", "i", "won").collect()} == {i: want[i] for i in range(len(claims))}


# Language


def test_language(spark, sf):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    found = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    held = [(r["lang"], found[r["doc_id"]]) for r in frame.select("doc_id", "lang").collect() if found[r["doc_id"]]["held_out"]]
    assert len(held) > 100 and sum(a == b["lang_pred"] for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.keep_identified(frame).columns == frame.columns


def test_language_odd_rows(spark):
    rows = [(i, f"the {i} house and water", "en", "s") for i in range(30)] + [(i, f"das {i} Haus und Wasser", "de", "s") for i in range(30, 60)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "123 $$ !", "de", "s"), (None, "das Haus", None, None), (None, "x " * 100_000, "en", "s"), (103, "Ünd", "xx", "s")]
    frame = docs(spark, [(*r, "p", True) for r in rows], ", lang_pred string, held_out boolean")
    found = language_id.identify(frame).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (100, 101, 102))
    assert {r["lang_pred"] for r in found if r["doc_id"] is not None and r["doc_id"] < 30} == {"en"}
    kept = language_id.keep_identified(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} >= set(range(60)) and not {100, 101, 102} & {r["doc_id"] for r in kept.collect()}
    assert language_id.keep_identified(frame, least=0.0).count() == len(rows) - 3
    german = language_id.keep_identified(frame, languages=["de"])
    assert {r["doc_id"] for r in german.collect()} >= set(range(30, 60)) and not set(range(30)) & {r["doc_id"] for r in german.collect()}
    assert language_id.identify(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, [(1, "abc", None, "s")])).collect()} == {"und"}


def test_predictions_decide_what_is_kept(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    odd = [
        "Это русский текст о погоде и о людях, которые живут в городе.", "日本語のテキストです。今日は天気がいい。", "γειά σου κόσμε τι κάνεις",
        "qbmgld gsvnsg pdvmjq paktmj afgkzs zekngi vdmrlv xkqzjw " * 5, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff " * 4,
    ]
    extra = spark.createDataFrame([(10_000_000 + i, t, None, "odd", len(t)) for i, t in enumerate(odd)], frame.schema)
    kept = {r["doc_id"] for r in language_id.keep_identified(frame.unionAll(extra)).select("doc_id").collect()}
    assert not any(i >= 10_000_000 for i in kept) and len(kept) >= 0.995 * frame.count()


def test_ids_of_many_rows_count_once(spark):
    """A hot id sends one row to the driver, not its thousands."""
    hot = spark.range(5000).selectExpr("1 as doc_id", "concat('the house and water ', id % 7) as text", "'en' as lang", "'s' as source")
    rest = docs(spark, [(10 + i, f"das {i} Haus und Wasser", "de", "s") for i in range(60)] + [(100 + i, f"the house {i} and the water", "en", "s") for i in range(60)])
    frame = hot.selectExpr("cast(doc_id as long) as doc_id", "text", "lang", "source").unionAll(rest)
    model = language_id.train(frame, sample=100)
    assert {"de", "en"} == set(model.languages)
    labels = spark.createDataFrame([(1, 1)] + [(10 + i, 0) for i in range(60)], "doc_id long, toxic int")
    machine = toxicity.train(frame, labels)
    assert machine is not None and toxicity.score_toxicity(frame, labels, machine).count() == 5120


def test_every_label_is_learned(spark):
    """More labels than 60, each with words of its own."""
    draw, rows = random.Random(12), []
    for k in range(66):
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)]
        rows += [(100 * k + i, " ".join(draw.choices(words, k=12)), f"x{k:02}", "s") for i in range(12)]
    truth = {r[0]: r[2] for r in rows}
    found = language_id.identify(docs(spark, rows)).collect()
    held = [(truth[r["doc_id"]], r["lang_pred"]) for r in found if r["held_out"]]
    assert {r["lang_pred"] for r in found} == set(truth.values()) and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_held_out(spark):
    import zlib

    frame = spark.range(50).select(language_id.held_out(F.col("id")).alias("a"), toxicity.held_out(F.col("id")).alias("b"), "id")
    for r in frame.collect():
        crc = zlib.crc32(str(r["id"]).encode())
        assert (r["a"], r["b"]) == (crc % 5 == 0, crc % 3 == 1)


# Toxicity


def test_toxicity(spark):
    frame, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, labels).collect()}
    held = [(r["toxic"], found[r["doc_id"]]["predicted"]) for r in labels.collect() if r["toxic"] is not None and found[r["doc_id"]]["held_out"]]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_pairs_of_terms_are_learned():
    draw = random.Random(6)
    filler = [f"{a}{b}o" for a in "abcdefgh" for b in "klmnp"]
    texts, toxic = [], []
    for _ in range(1500):
        insult, group = draw.random() < 0.4, draw.random() < 0.4
        texts.append(" ".join([*draw.sample(filler, 6), *["badword"] * insult, *["people"] * group]))
        toxic.append(float(insult and group))
    held = [d for first, owner, terms in toxicity.terms_of(texts) for d in (terms[owner == k] for k in range(owner[-1] + 1))]
    machine = toxicity.Machine(held, np.array(toxic))
    score = machine.scores(["badword ako", "people ako", "badword people ako", "ako", ""])
    assert score[2] > 0.7 > 0.5 > max(score[0], score[1], score[3], score[4])


def test_pairs_of_terms_that_tell_nothing_alone_are_learned():
    """Both words are in a tenth of the toxic and of the clean texts; only together they are toxic."""
    draw = random.Random(6)
    filler = [f"{a}{b}o" for a in "abcdefgh" for b in "klmnp"]
    texts, toxic = [], []
    for k in range(3000):
        bad, part = k % 2, k // 2 % 10
        words = ["badword", "people"] if bad and part == 0 else ["badword"] if not bad and part == 0 else ["people"] if not bad and part == 1 else []
        texts.append(" ".join([*draw.sample(filler, 6), *words, *["otherbad"] * (bad and part > 0)]))
        toxic.append(float(bad))
    held = [d for first, owner, terms in toxicity.terms_of(texts) for d in (terms[owner == k] for k in range(owner[-1] + 1))]
    score = toxicity.Machine(held, np.array(toxic)).scores(["badword ako", "people ako", "badword people ako", "ako"])
    assert score[2] > 0.7 > 0.5 > max(score[0], score[1], score[3])


def test_texts_without_a_known_term_get_the_bias():
    machine = toxicity.Machine([np.array([1], np.uint64)] * 30 + [np.array([2], np.uint64)] * 30, np.repeat([1.0, 0.0], 30))
    assert len(machine.terms) == 2 and len(set(machine.scores(["some words", "other words"]))) == 1


def test_toxicity_odd_rows(spark):
    rows = [(i, f"{'badword' if i % 2 else 'nice'} text {i}", "en", "s") for i in range(200)] + [(500, None, None, None), (500, "", "en", "s"), (None, "badword " * 50_000, "en", "s")]
    frame = docs(spark, [(*r, 0.5) for r in rows], ", score double")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(1, 0, 1), (7, None, 1), (None, 1, 1), (9, 5, 1), (9999, 1, 1)], "doc_id long, toxic int, score int")
    found = toxicity.score_toxicity(frame, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in found if r["doc_id"] is not None and r["doc_id"] < 200)
    assert {r["predicted"] for r in found if r["doc_id"] == 500} == {0} and {r["predicted"] for r in found if r["doc_id"] is None} == {1}
    none = toxicity.score_toxicity(frame, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.score_toxicity(frame.limit(0), labels).count() == 0
