import random
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import chat, decontaminate, language, mixing, neardup, secrets, substring, tokens, topk, toxicity
from earshot.llm.queries import tokenizer_path

ODD = brute.odd_documents()
random.seed(5)


def rows_of(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def words(n, stock=30):
    return " ".join(f"v{random.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return brute.frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.frame(spark, [])


# 1


@pytest.mark.parametrize("hot", [256, 1])
def test_substring_dedup(odd, hot):
    got = rows_of(substring.substring_dedup(odd, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(ODD, 35), key=repr)


def test_substring_dedup_of_dense_repeats(spark):
    rows = [(i, words(random.randrange(1, 120), 3), "en", "s") for i in range(150)]
    rows += [(200 + i, "pre%d " % i + brute.PASSAGE + " post%d" % i, "en", "s") for i in range(40)]
    want = sorted(brute.substring(rows, 6), key=repr)
    for hot in (1000, 3):
        found = substring.substring_dedup(brute.frame(spark, rows), window=6, order=3, hot=hot)
        assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_substring_dedup_of_nothing(none):
    assert substring.substring_dedup(none).collect() == []


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "rolling", lambda h, n, f: np.zeros(len(h) - n + 1, np.uint64))
    packed = [b"a b c", b"b c d", b"a b x"]
    row, offset = substring.repeated_windows(packed, np.ones(3, np.int64), 2)
    assert sorted(zip(row.tolist(), offset.tolist())) == [(0, 0), (0, 1), (1, 0), (2, 0)]


# 2

ITEMS = [
    (1, "Tok10, tok11 tok12 tok13! tok14 tok15 tok16 tok17 tok18 tok19 tok20"),
    (2, "one"),
    (20, "nothing here is in any of the documents that are being looked at now"),
    (3, None),
    (4, ""),
    (None, "so so so"),
    (5, "SO so"),
    (5, "SO so"),
    (6, "shared50 shared51 shared52 shared53 shared54 shared55 shared56 shared57 shared58 shared59 after"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_contamination(spark, odd, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.find_contamination(odd, items, block_bytes=block_bytes)
    assert set(odd.columns) <= set(got.columns)
    seen = got.select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s")
    )
    assert rows_of(seen, *seen.columns) == sorted(brute.contamination(ODD, ITEMS, 10), key=repr)
    clean = decontaminate.clean_documents(odd, items, block_bytes=block_bytes)
    assert clean.columns == odd.columns
    assert clean.count() == sum(r[2] == 0 for r in brute.contamination(ODD, ITEMS, 10))


def test_hits_map_to_the_original_text(spark):
    docs = spark.createDataFrame([(1, "É – So,SO; then")], "doc_id int, text string")
    items = spark.createDataFrame([(5, "so so")], "item_id int, text string")
    (row,) = decontaminate.find_contamination(docs, items).collect()
    (span,) = row["hit_spans"]
    assert row["text"][span["start"] : span["end"]] == "So,SO"


def test_no_benchmark_and_no_documents(spark, odd, none):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(odd, empty).filter("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.find_contamination(none, spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


# 3


def labelled(spark):
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        group = random.choice(["women", "men", "muslims", "christians"])
        # One group is named more often in bad texts; the penalty must keep that out of the score.
        group = "women" if bad and random.random() < 0.7 else group
        rows.append((i, f"{words(20, 200)} {group} {'vile rotten' if bad else 'kind'} {words(5, 200)}", int(bad)))
    return spark.createDataFrame(rows, "doc_id int, text string, toxic int")


def test_toxicity_learns_and_ignores_group_mentions(spark):
    data = labelled(spark)
    model = toxicity.fit_toxicity(data, learn=F.col("doc_id") % 4 != 1)
    held = toxicity.score_toxicity(data.filter("doc_id % 4 = 1"), model)
    assert held.filter("predicted != toxic").count() == 0
    loose = toxicity.fit_toxicity(data, learn=F.col("doc_id") % 4 != 1, swap_penalty=0.0)
    gap = lambda m: abs(m.score({b"women"}) - m.score({b"men"}))
    assert gap(model) < 0.02 and gap(model) < gap(loose) / 2


@pytest.mark.parametrize("group, other", [("muslims", "christians"), ("immigrants", "locals")])
def test_beginnings_of_group_names_do_not_raise_the_score(spark, group, other):
    draw = random.Random(11)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        named = group if draw.random() < (0.8 if bad else 0.1) else other
        text = " ".join(f"v{draw.randrange(200)}" for _ in range(20))
        rows.append((i, f"{text} {named} {draw.choice(['vile', 'rotten', 'hm']) if bad else 'kind'}", int(bad)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id int, text string, toxic int"))
    apart = [
        sum(model.weights.get(f, 0.0) for f in toxicity.features(f"a note about {name}")) for name in (group, other)
    ]
    assert abs(apart[0] - apart[1]) < 0.25, apart


def test_toxicity_is_fitted_on_all_of_a_sample_of_12000(spark, monkeypatch):
    seen = []
    plain = toxicity._newton
    monkeypatch.setattr(toxicity, "_newton", lambda x, y, *rest: seen.append(x.shape) or plain(x, y, *rest))
    bad = F.col("doc_id") % 3 == 0
    data = spark.range(9000).select(
        F.col("id").cast("int").alias("doc_id"),
        F.concat_ws(" ", F.lit("text"), F.concat(F.lit("own"), "id"), F.when(F.col("id") % 3 == 0, "vile").otherwise("kind")).alias("text"),
    ).withColumn("toxic", bad.cast("int"))
    model = toxicity.fit_toxicity(data)
    assert seen[0][0] == 9000 and seen[0][1] <= 601 + 2 * len(toxicity.IDENTITY)
    assert toxicity.score_toxicity(data, model).filter("predicted <> toxic").count() == 0


def test_copies_do_not_shrink_the_toxicity_sample(spark):
    once = labelled(spark).withColumn("text", F.concat_ws(" ", "text", F.col("doc_id").cast("string")))
    copies = once.crossJoin(spark.range(20).select(F.col("id").alias("copy")))
    want, got = (toxicity.fit_toxicity(d, max_rows=250) for d in (once, copies))
    assert got.weights == want.weights and got.intercept == want.intercept


def test_toxicity_of_odd_documents(spark, odd, none):
    model = toxicity.fit_toxicity(labelled(spark))
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == len(ODD) and got.filter("score is null or score < 0 or score > 1").count() == 0
    empty = {r["score"] for r in got.filter("coalesce(text, '') = ''").collect()}
    assert len(empty) == 1
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    nothing = toxicity.fit_toxicity(none.withColumn("toxic", F.lit(1)))
    assert {r["score"] for r in toxicity.score_toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.score_toxicity(none, model).count() == 0


# 4


def test_turns_are_read_back():
    turns = [("user", chat.escape("x")), ("a:b#", "\\### Assistant: </turn> ok\n### user: hi</turn>\n"), ("assistant", "")]
    text, mask = chat.format_turns(turns)
    assert chat.read_turns(text) == turns and [text[a:b] for a, b in mask] == [""]
    with pytest.raises(ValueError):
        chat.read_turns("### user: no end")


def test_best_branch_of_a_tree(spark):
    # Tree 1: 1 - 2 - 3 and 1 - 4 - 5; tree 2: a chain of 21; tree 3: a cycle; null tree: one orphan.
    rows = [
        (1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "low", 0.0), (1, 3, 2, "user", "leaf", 0.5),
        (1, 4, 1, "assistant", "high", 2.0), (1, 5, 4, "user", None, None),
        *[(2, i, i - 1 if i else None, "user", f"t{i}", 0.0) for i in range(21)],
        (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (3, 3, 2, "user", "z", 0.0),
        (None, 7, 99, "user", "orphan", 0.0), (4, None, None, "user", "no id", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree_id int, message_id int, parent_id int, role string, text string, score double")
    got = chat.format_conversations(df.selectExpr("*", "1 AS node", "2 AS tree"), score_col="score", branches=2).collect()
    read = sorted([(r["tree_id"], r["place"], [t for _, t in chat.read_turns(r["formatted"])]) for r in got], key=repr)
    assert read == sorted(
        [
            (1, 1, ["root", "high", ""]),
            (1, 2, ["root", "low", "leaf"]),
            (2, 1, [f"t{i}" for i in range(21)]),
            (None, 1, ["orphan"]),
        ],
        key=repr,
    )
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_paths_against_recursion(spark):
    """A comb, a random forest with ties and a cycle: best branches as by walking up from every leaf."""
    rng = random.Random(5)
    nodes = {("comb", i): (i - 1 if i % 2 else i - 2) if i else None for i in range(41)}
    for i in range(150):
        tree = f"t{i % 3}"
        earlier = [n for t, n in nodes if t == tree]
        nodes[tree, 1000 + i] = rng.choice(earlier) if earlier and rng.random() < 0.95 else None
    score = {key: rng.choice([0.0, 1.0, 2.0]) for key in nodes}
    rows = [(t, n, p, score[t, n]) for (t, n), p in nodes.items()] + [("t0", 1, 2, 9.0), ("t0", 2, 1, 9.0), ("t0", 3, 2, 9.0)]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double")
    want = []
    for tree in {t for t, _ in nodes}:
        inner = {p for (t, _), p in nodes.items() if t == tree}
        ranked = []
        for leaf in [n for t, n in nodes if t == tree and n not in inner]:
            path = [leaf]
            while nodes[tree, path[-1]] is not None:
                path.append(nodes[tree, path[-1]])
            ranked.append((-sum(score[tree, n] for n in path) / len(path), leaf, path))
        for place, (_, leaf, path) in enumerate(sorted(ranked)[:3]):
            want += [(tree, leaf, n, up, place + 1) for up, n in enumerate(path)]
    got = [tuple(r) for r in chat.best_paths(df, branches=3).select("tree", "leaf", "node", "up", "place").collect()]
    assert sorted(got) == sorted(want)


def test_chat_reads_long_turns_in_little_memory():
    turns = [("user", "ab\\ <c#" * 200_000), ("assistant", "\\")]
    text, _ = chat.format_turns(turns)
    tracemalloc.start()
    assert chat.read_turns(text) == turns
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)


# 5


def test_code_lengths_are_those_of_the_plain_model():
    train, text = ["abracadabra", "", "cada é"], ["abra", "zzéabrac", ""]
    data, starts, ends = language.joined(train)
    keys = np.concatenate([language.grams(data, int(a), int(b)) for a, b in zip(starts, ends) if a < b])
    model = language.PpmModel({"x": language.ContextTree(*[x.astype(t) for x, t in zip(np.unique(keys, return_counts=True), (np.uint64, float))])})
    for _ in range(2):
        assert np.allclose(model.lengths(text)[:, 0], [brute.code_length(train, t) for t in text])


def test_copies_do_not_shrink_the_language_sample(spark):
    rows = [(f"{a} {words(4, 900)} {i}", lang) for i in range(300) for a, lang in (("the cat", "en"), ("le chat", "fr"))]
    once = spark.createDataFrame(rows, "text string, lang string")
    copies = once.crossJoin(spark.range(20).select(F.col("id").alias("copy")))
    want, got = (language.fit_ppm(d, F.lit(True), max_rows=100) for d in (once, copies))
    texts = [t for t, _ in rows[:40]]
    assert np.array_equal(want.lengths(texts), got.lengths(texts))


def test_languages_of_odd_documents(spark, odd, none):
    rows = [(i, f"the cat and the {words(3)} of it", "en") for i in range(40)]
    rows += [(100 + i, f"le chat et la {words(3)} de ça", "fr") for i in range(40)]
    data = spark.createDataFrame([*rows, (999, None, "en"), (998, "x", None)], "doc_id int, text string, lang string")
    model = language.fit_ppm(data, F.col("doc_id") % 2 == 0)
    held = language.predict_language(data.filter("doc_id % 2 = 1 and text is not null and lang is not null"), model)
    assert held.filter("lang_pred <> lang").count() == 0
    got = language.predict_language(odd, model)
    assert set(odd.columns) <= set(got.columns) and got.count() == len(ODD)
    assert got.filter("(coalesce(trim(text), '') = '') and (lang_pred <> 'und' or score <> 0)").count() == 0
    assert language.predict_language(spark.createDataFrame([("12 - 34",)], "text string"), model).first()[1] == "und"
    nothing = language.fit_ppm(none, F.lit(True))
    assert {r["lang_pred"] for r in language.predict_language(odd, nothing).collect()} == {"und"}


# 6

KEY = "AKIA" + "Q7" * 8
SECRETS = [
    (1, f"password = 'hunter2hunter' and {KEY} x", "en", "a"),
    (2, 'API_KEY":"short" api_key: "longenough1" secret: token: abcdefgh12', "en", "b"),
    (3, "d41d8cd98f00b204e9800998ecf8427e" * 2 + " \U0001f600 token=d41d8cd98f00b204e9800998ecf8427e", "en", "b"),
    (4, None, "en", None),
    (5, "", None, "a"),
    (6, "paſſword=abcdefgh1 toKen=abcdefgh1 AKIAshort", "en", "a"),
    (7, "key Zk3vQ9xL2mN8bT5wR1cY7uJ4 only here", "en", "a"),
    (8, "key Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8 copied", "en", "a"),
    (9, "key Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8 copied", "en", "b"),
    (None, f"{KEY}", "en", "c"),
    (1, f"password = 'hunter2hunter' and {KEY} x", "en", "a"),
]


def test_secrets(spark, none):
    got = secrets.scan_secrets(brute.frame(spark, SECRETS)).collect()
    text = lambda xs: [f"{x['kind']}:{x['start']}:{x['end']}" for x in xs]
    assert sorted([(r["doc_id"], text(r["base"])) for r in got], key=repr) == sorted(
        [(d, brute.base_secrets(t)) for d, t, *_ in SECRETS], key=repr
    )
    added = {r["doc_id"]: text(r["added"]) for r in got}
    assert added[7] == ["opaque:4:28"] and added[8] == [] and added[9] == []
    copied = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in got}
    assert copied[None] == (0, 1) and copied[1] == (1, 1)
    assert secrets.scan_secrets(none).collect() == []


# 7


def test_top_k(spark):
    rows = [(i, [random.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(310, [1.0, 2.0]), (320, [3.0, -1.0]), (330, []), (340, [1e7] * 6), (350, [1e12] * 6), (400, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS n")
    want = sorted(brute.top_k(rows, lambda i: i % 10 == 0, 5))
    for block_rows, bins in ((16, 4096), (2048, 1024)):
        got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, block_rows=block_rows, bins=bins, slices=4)
        assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.exact_top_k(df, F.lit(False)).count() == 0


# 8


def test_seats():
    for _ in range(200):
        n = random.randrange(1, 8)
        w = [random.choice([0, 1, 2, 5.5, random.random() * 50]) for _ in range(n)]
        most = [random.randrange(0, 30) for _ in range(n)]
        seats = random.randrange(0, 60)
        assert mixing.sainte_lague(w, seats, most) == brute.seats_one_by_one(w, seats, most)


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 15.0] and mixing.targets([], []) == []


def check_mix(rows, options, docs):
    got = [r.asDict() for r in mixing.mix_quotas(docs, **options).collect()]
    again = [r.asDict() for r in mixing.mix_quotas(docs, **options).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes = sorted([(d, len(brute.PLAIN.findall(t or ""))) for d, t, *_ in rows], key=repr)
    assert sorted([(r["doc_id"], r["size"]) for r in got], key=repr) == sizes
    block = options.get("block_words", 16)
    total = sum(n for _, n in sizes)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * total)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * block * (1 + len({r["shard"] for r in own}))
        for r in own:
            assert 0 <= r["taken"] <= 2 * r["size"]
            if r["blocks"]:
                times = mixing.times_taken(r["size"], r["first"], r["blocks"], r["quota"], r["offset"], block)
                assert times.sum() == r["taken"]
    return got


def test_mix(spark, odd, none):
    check_mix(ODD, {}, odd)
    rows = [(i, words(random.randrange(0, 60)), "en", random.choice(["a", "b", None, "c", "Z"])) for i in range(300)]
    docs = brute.frame(spark, rows)
    options = {"shard_words": 500, "block_words": 4}
    got = check_mix(rows, options, docs)
    assert max(r["shard"] for r in got) > 0
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == docs.columns
    out: dict[int, int] = {}
    for r in mixed.select("doc_id", "text").collect():
        out[r[0]] = out.get(r[0], 0) + len(r[1].split())
    assert {k: v for k, v in out.items() if v} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.mix_quotas(none).count() == 0 and mixing.mix(none).count() == 0


def test_pipeline_mix_meets_the_targets_of_small_sources(spark):
    import corpus_pipeline

    draw = random.Random(3)
    sizes = {f"s{i:03}": draw.randrange(50, 301) for i in range(300)}
    rows = []
    for source, n in sizes.items():
        cut = draw.randrange(1, n)
        rows += [(len(rows) + j, " ".join(["w"] * k), "en", source) for j, k in enumerate((cut, n - cut))]
    goal = mixing.targets(list(sizes.values()), [mixing.WEIGHTS[i % 3] for i in range(300)])
    mixed = corpus_pipeline.mix_sources(spark, brute.frame(spark, rows), "")
    taken = dict.fromkeys(sizes, 0)
    for r in mixed.select("source", "text").collect():
        taken[r["source"]] += len(r["text"].split())
    off = {s: (taken[s], g) for s, g in zip(sizes, goal) if not taken[s] or abs(taken[s] - g) > 32}
    assert not off, off


def test_mix_keeps_odd_documents(odd):
    by_id: dict = {}
    for r in mixing.mix(odd).select("doc_id", "text").collect():
        by_id.setdefault(r[0], []).append(r[1])
    assert by_id[1] == [None] and by_id[2] == [""]


# 9


def test_tokens(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    more = ["a  b", " a", "a\n\nb", "it's <|endoftext|> x", "3.14, a.b,c . d", "tab\tx", "　wide x", "x\n"] * 3
    rows = [*ODD, *((50 + i, t, "en", "s") for i, t in enumerate(more))]
    path = tokens.write_tokens(brute.frame(spark, rows), str(tmp_path / "t"), tokenizer_path(), dictionary_bytes=1 << 12)
    got = tokens.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    want = sorted([(d, plain.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, *_ in rows], key=repr)
    assert sorted([(r["doc_id"], list(r["ids"])) for r in got], key=repr) == want
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    digest, dictionary = tokens.read_dictionary(spark, path)
    assert dictionary
    block = spark.read.parquet(f"{path}/blocks").filter(F.array_contains("ids", 12)).first()
    at = block["ids"].index(12)
    one = tokens.opener(dictionary)(tokens.frame(bytes(block["payload"]), block["ends"], at))
    assert np.frombuffer(one, "<u2").tolist() == plain.encode("one").ids + [0] and block["dictionary"] == digest
    empty = tokens.write_tokens(none, str(tmp_path / "e"), tokenizer_path())
    assert tokens.read_tokens(spark, empty).count() == 0


# 10


def near_rows():
    rows = list(ODD)
    base = [[f"b{g}w{i}" for i in range(80)] for g in range(6)]
    n = 100
    for g, b in enumerate(base):
        for _ in range(40):
            copy = b[:]
            for _ in range(random.randrange(0, 6)):
                copy[random.randrange(len(copy))] = f"n{random.randrange(10**6)}"
            rows.append((n, " ".join(copy), "en", f"s{g}"))
            n += 1
    rows += [(n + i, words(40, 500) + " " + " ".join(base[0][:25]), "en", "s") for i in range(60)]
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 8, "block": 4}, {"block_bytes": 2000}])
def test_near_duplicates(spark, options):
    rows = near_rows()
    got = neardup.near_duplicates(brute.frame(spark, rows), **options)
    want = brute.components(rows, 3, 85)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert got.filter("kept <> (doc_id is null or doc_id = component_id)").count() == 0


def test_long_chains_are_confirmed_block_by_block(spark):
    """Each text is near the next one only, so two members settle little and blocks must meet."""
    random.seed(3)
    chain = [f"c{i}" for i in range(180)]
    rows = [(1000 + i, " ".join(chain[3 * i : 3 * i + 60]), "en", "s") for i in range(40)]
    rows += [(2000 + i, " ".join(chain[:60] + [f"far{i}x{j}" for j in range(14)]), "en", "s") for i in range(12)]
    rows = [r for r in rows for _ in range(2)]
    random.shuffle(rows)
    got = neardup.near_duplicates(brute.frame(spark, rows), block=4)
    want = brute.components(rows, 3, 85)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert len({c for _, _, c in want}) > 1 and max(Counter(c for *_, c in want).values()) > 20


def test_one_of_each_group_stays(spark, odd, none):
    kept = neardup.keep_one(odd, words=5, percent=80)
    assert kept.columns == odd.columns
    ids = sorted([r["doc_id"] for r in kept.select("doc_id").collect()], key=repr)
    assert ids == sorted([d for d, _, c in brute.components(ODD, 5, 80) if d == c], key=repr)
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_blocks_of_unlike_members_meet(spark):
    """A node that does not branch: nothing may be lost between its blocks."""
    random.seed(8)
    sig = [bytes(random.choices((0, 1), k=neardup.SIGNATURE)) for _ in range(30)]
    sig += [bytes([*s[:120], *([9] * 8)]) for s in sig]
    nodes = spark.createDataFrame([(1, 60, i, s) for i, s in enumerate(sig)], "path bigint, n bigint, id bigint, sig binary")
    links = [tuple(r) for part in neardup._dense(nodes, 100, 8) for r in part.select("src", "dst").collect()]
    name = {i: i for i in range(60)}
    for _ in range(60):
        for x, y in links:
            name[x] = name[y] = min(name[x], name[y])
    assert all(name[i] == name[i + 30] for i in range(30))


# The queries and the pipeline


def test_pipeline_stages(spark, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names, name
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(path)
    tokens_out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert tokens_out.count() == docs.count()
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_queries_match_their_sql(spark):
    from harness import compare, connect

    from earshot.llm.queries import CATALOG

    sf = "/root/testdata/sf0.001"
    con = connect(sf)
    for name, sql in CATALOG.sql.items():
        assert compare(spark, con, CATALOG.queries[name], sql, sf) is None, name


def test_held_out_documents(spark):
    from earshot.llm.queries import CATALOG

    sf = "/root/testdata/sf0.01"
    found = CATALOG.queries["op5_language_id"](spark, sf).filter("held_out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    n, right = found.join(docs, "doc_id").agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert right >= 0.97 * n
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = CATALOG.queries["op3_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id")
    good, bad = scored.filter("toxic = 0"), scored.filter("toxic = 1")
    assert good.filter("predicted = 1").count() <= 0.02 * good.count()
    assert bad.filter("predicted = 1").count() >= 0.5 * bad.count()
