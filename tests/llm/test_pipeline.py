"""The corpus pipeline and the parts of its stages that no query shows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forelake.llm import common, langid, mixing, pages, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, n):
    letters = {"en": "etaoinshr", "de": "äöüßzkxwqv"}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(i, prose(rng, "en" if i % 2 else "de", rng.randint(30, 200)), "en" if i % 2 else "de", None if i % 9 == 0 else f"s{i % 3}") for i in range(120)]
    words = out[7][1].split()
    words[len(words) // 2] = "changed"
    out += [(200, out[5][1], "en", "s1"), (201, " ".join(words), "en", "s2"), (202, None, "en", "s1"), (203, "", None, None), (204, "12 34 !", "en", "s1"), (5, out[5][1], "en", "s1")]
    # Alike by far over four fifths of their shingles, but not by three bits.
    long = prose(rng, "en", 300).split()
    out.append((300, " ".join(long), "en", "s0"))
    for k in (60, 150, 240):
        long[k] = "other"
    out.append((301, " ".join(long), "en", "s0"))
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def packed(df):
    return sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()), key=str)


def test_pipeline_runs_alike_again_and_keeps_one_of_each(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(rows[::-1], SCHEMA).repartition(2).write.parquet(f"{tmp_path}/b/documents.parquet")
    one, two = (packed(corpus_pipeline.run(spark, f"{tmp_path}/{x}")) for x in "ab")
    assert one == two
    ids = {r[0] for r in one}
    assert not ids & {200, 201, 202, 203, 204, 301} and {5, 7, 300} <= ids


def test_stages_keep_the_columns_and_take_empty_tables(spark, rows):
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", doc string, sig long")
    docs = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == extra.columns, name
        assert stage(spark, extra.limit(0), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, extra.limit(0), "").count() == 0
    assert docs.count() > 50


def test_texts_reach_the_network_in_small_batches(spark, monkeypatch):
    def label(net, texts):
        return ["en"] * len(texts), np.full(len(texts), float(sum(map(len, texts)) < 5_000_000))

    monkeypatch.setattr(langid, "label", label)
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('text ', 20000) AS text", "'en' AS lang", "'s' AS source", "100000L AS n_chars").coalesce(1)
    assert corpus_pipeline.known_language(spark, docs, "").count() == 400


def test_resembling_texts_are_found_exactly(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))] for _ in range(40)]
    texts = []
    for words in base:
        texts.append(words)
        for changes in (1, 2, 4, 9, 20):
            copy = list(words)
            for k in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[k] = f"x{rng.randint(0, 10**6)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", " ", "a b", "a b", "short one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs, 5, 0, least=0.8).collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if simhash.fingerprint(texts[i], 5) == simhash.fingerprint(texts[j], 5) or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert kept == set(root) and len(kept) < 200


def test_groups_of_one_band_end_after_the_rounds(spark):
    rng = random.Random(5)
    sets = [" ".join(f"v{rng.randint(0, 30)}" for _ in range(40)) for _ in range(30)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "sig long, text string")
    classes = spark.createDataFrame([(i, [7], i) for i in range(30)], "sig long, bands array<long>, component long")
    assert simhash.resemblance_links(classes, texts, 5, 0.8).count() == 0
    alike = spark.createDataFrame([(i, sets[i % 10]) for i in range(30)], "sig long, text string")
    found = {(r["a"], r["b"]) for r in simhash.resemblance_links(classes, alike, 5, 0.8).collect()}
    assert {(0, 10), (0, 20), (1, 11), (1, 21), (2, 12), (2, 22)} <= found and all((b - a) % 10 == 0 for a, b in found)


def test_no_link_of_a_mixed_band_is_lost(spark):
    """One key holds 60 unlike texts and a copy of each with a word changed; a component's second text alone is like another's."""
    rng = random.Random(6)
    pairs = []
    for _ in range(60):
        words = [f"v{rng.randint(0, 300)}" for _ in range(120)]
        pairs.append((" ".join(words), " ".join([*words[:60], "x", *words[61:]])))
    # All firsts come before all seconds, so that neighbours in a row are never alike.
    rows = [(i, p[0]) for i, p in enumerate(pairs)] + [(100 + i, p[1]) for i, p in enumerate(pairs)]
    texts = spark.createDataFrame(rows, "sig long, text string")
    classes = spark.createDataFrame([(i, [7], i) for i, _ in rows], "sig long, bands array<long>, component long")
    found = simhash.resemblance_links(classes, texts, 5, 0.8)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, 100 + i) for i in range(60)}
    three = [(1, pairs[0][0]), (2, pairs[1][0]), (3, pairs[1][1])]
    classes = spark.createDataFrame([(1, [7], 1), (2, [7], 1), (3, [7], 3)], "sig long, bands array<long>, component long")
    found = simhash.resemblance_links(classes, spark.createDataFrame(three, "sig long, text string"), 5, 0.8)
    assert [(r["a"], r["b"]) for r in found.collect()] == [(1, 3)]


def test_pairs_by_shared_shingles_are_all(spark):
    """Chains of texts that drift apart, with shared passages: every pair of 0.8 or more is met, none within a component."""
    rng = random.Random(7)
    common, sets = list(range(40)), []
    for i in range(12):
        base = [*common, *(1000 * (i + 1) + k for k in range(rng.randint(40, 160)))]
        for step in range(6):
            for k in rng.sample(range(len(base)), 4):
                base[k] = 10**6 + rng.randint(0, 10**6)
            sets.append(sorted(set(base)))
    frame = spark.createDataFrame(list(enumerate(sets)), "sig long, shingles array<long>")
    rows = spark.createDataFrame([(i, i if i % 3 else 0) for i in range(len(sets))], "sig long, component long")
    found = {(r["a"], r["b"]) for r in simhash.resembling(simhash.sharing(rows, frame, 0.8), frame, 0.8).collect()}
    want = set()
    for j, y in enumerate(map(set, sets)):
        for i, x in enumerate(map(set, sets[:j])):
            if (i % 3 or j % 3) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                want.add((i, j))
    assert found == want and len(want) > 50


def test_training_sample_is_the_first_documents_by_checksum(spark):
    import hashlib

    rows = [(i, f"text number {i} of some words", "en" if i % 3 else "de") for i in range(3000)] + [(1, "text number 1 of some words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.training_sample(docs, docs_per_language=20, stretches=1)
    want = set()
    import zlib

    for lang in ("en", "de"):
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, k in rows if k == lang and zlib.crc32(str(i).encode()) % 4 != 2)
        want |= {i for _, i in ids[:20]}
    assert {int(t.split()[2]) for t in texts} == want and len(langs) == len(texts)


def test_every_prefix_of_slots_is_near_the_shares(spark):
    targets = spark.createDataFrame([("a", 50_000.0), ("b", 20_000.0), (None, 9_000.0), ("c", 500.0)], "source string, target double")
    slots = [r["source"] for r in mixing.schedule(targets, 100).orderBy("slot", "rank").collect()]
    total = len(slots)
    for source, quota in (("a", 500), ("b", 200), (None, 90), ("c", 5)):
        mine = np.cumsum([s == source for s in slots])
        assert mine[-1] == quota
        assert np.abs(mine - quota / total * np.arange(1, total + 1)).max() < 4


def test_line_breaks_are_white_space_inside_their_block(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "<html><body><article><p>x<br>y<br/>z</p><p>w</p></article></body></html>")], "page_id long, url string, html string")
    assert pages.extract(df).first()["text"] == "x y z\nw"


def test_mix_of_documents_plans_no_schedule(spark, rows, tmp_path):
    """Each exchange is a thread of the driver for a minute, with memory of its own; the words taken are those of the mix's pieces."""
    docs = spark.createDataFrame(rows, SCHEMA)
    pieces = mixing.mix(docs)[1].groupBy("row", "pass").agg(F.sum("length").alias("words")).agg(F.count("*"), F.sum("words")).first()
    mixed = mixing.mixed_documents(docs)
    joins = mixed._jdf.queryExecution().sparkPlan().toString().count("Join ")
    taken = mixed.select(F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).agg(F.count("*"), F.sum("n")).first()
    assert tuple(taken) == tuple(pieces)
    # Before: 12, with the slots' cells, ranks and names.
    assert joins <= 4


def test_settled_components_need_no_further_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(common, "_star", lambda edges, star=common._star: rounds.append(1) or star(edges))
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(50)], "a long, b long")
    assert sorted(map(tuple, common.connected(pairs, "a", "b").collect())) == sorted([(2 * i, 2 * i) for i in range(50)] + [(2 * i + 1, 2 * i) for i in range(50)])
    assert len(rounds) == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (-5, 100)], "a long, b long")
    found = dict(map(tuple, common.connected(chain, "a", "b").collect()))
    assert found == {i: 0 for i in range(41)} | {-5: -5, 99: -5, 100: -5}


def test_a_round_of_components_reads_its_links_once_for_both_directions(spark, monkeypatch):
    frame, plans = type(spark.range(1)), []
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(50)], "a long, b long")
    write = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: plans.append(self._jdf.queryExecution().sparkPlan().toString()) or write(self, *a, **b))
    assert common.connected(pairs, "a", "b").count() == 100
    # Before: 4 joins, and 7 unions that each read the links, or all that they come from, once for every side.
    assert [(p.count("Join "), p.count("Union")) for p in plans] == [(3, 0)]


def test_links_are_read_by_few_tasks(spark):
    many = spark.range(0, 45_000, 1, 64).selectExpr("id AS a", "id % 7 AS b")
    assert common.stage_rows(many).rdd.getNumPartitions() == 3
    assert common.stage_rows(many.limit(0)).count() == 0


def test_shared_shingles_too_late_for_the_resemblance_pair_no_texts(spark):
    """Thirty sets of 50 with their own rare shingles and a common rest: 45 common ones suffice for 0.8, 44 do not."""
    for own, pairs in ((6, 0), (5, 435)):
        sets = [[1000 * (i + 1) + k for k in range(own)] + list(range(50 - own)) for i in range(30)]
        frame = spark.createDataFrame(list(enumerate(sets)), "sig long, shingles array<long>")
        rows = spark.createDataFrame([(i, i) for i in range(30)], "sig long, component long")
        # Before, 44 common ones paired all, since they begin within the prefix of eleven.
        assert simhash.sharing(rows, frame, 0.8).count() == pairs
