"""Corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forelake.llm import common, fingerprints, langid, licenses, linededup, mixing, neighbours, packing, pages, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, sig string, pos int, row string"


def sample_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = line(90)
    texts = ["\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts += [texts[3], texts[3], texts[4] + " tail", line(40) + "\n" + shared + "\n" + line(9), shared + " " + line(60), line(5000)]
    return texts + [None, "", " \n\t", "\n\n", "É ß Σ", "A", "Common  Line here\nx", "common  line HERE \ny\ny"]


@pytest.fixture(scope="module")
def texts():
    return sample_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 4}", len(t or ""), "a", "b", 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing_holds_every_token_once(docs, texts, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs.unionByName(docs.where("doc_id = 3"))).collect()
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    pieces = Counter()
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: len(w) * (2 if i == 3 else 1) for i, w in enumerate(want)}
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_packing_with_a_tokenizer_of_another_rule(spark, texts):
    """A file with another splitting rule encodes whole texts; many pieces are dealt to many tasks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.splits_by_rule(path) and packing.splits_by_rule(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, end = Tokenizer.from_file(path), 7
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, "a long text, in many pieces " * 3000)]
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for i, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=path, window=64, end_id=end, pieces_per_task=400).collect()
    assert len({r["sequence_id"] >> 40 for r in got}) > 2
    assert Counter((r["doc_id"], r["start"]) for r in got) == Counter((i, s) for i, w in want.items() for s in range(0, len(w), 64))
    for r in got:
        assert zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]


def test_best_fit_decreasing_takes_the_tightest_window():
    assert packing.best_fit_decreasing([7, 6, 4, 3, 3, 1], 10) == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0), (2, 3)]
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 50) for _ in range(300)), reverse=True)
    free = []
    for length, (number, offset) in zip(lengths, packing.best_fit_decreasing(lengths, 50), strict=True):
        fits = [c for c in free if c >= length]
        if number == len(free):
            assert not fits
            free.append(50)
        assert 50 - offset == free[number] and (not fits or free[number] == min(fits))
        free[number] -= length


def line_oracle(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, texts, empty):
    want = line_oracle(list(enumerate(texts)))
    got = by_id(linededup.dedup_lines(docs))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in got.items()} == want
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_splits_a_hot_line(spark):
    rows = [(i, f"the very same line\nown line number {i}\nthe very same line") for i in range(300)]
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in got.items()} == line_oracle(rows)


def test_line_dedup_null_ids_come_last(spark):
    rows = [(None, "a line held twice"), (8, "a line held twice"), (8, "a line held twice")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in got) == [(-1, 1), (8, 0), (8, 0)]


def components(prints, bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def simhash_oracle(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts, empty):
    prints = {i: simhash_oracle(t) for i, t in enumerate(texts)}
    got = by_id(simhash.near_duplicates(docs))
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == components(prints, 3)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(docs).count() == len(set(components(prints, 3).values()))


def test_gray_index_links_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(3)
    prints = set()
    for base in (rng.getrandbits(64) for _ in range(6)):
        for _ in range(60):
            p = base
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints}
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), 3)
    got = {r["node"]: r["root"] for r in common.connected(links, "a", "b").collect()}
    want = components({s: p for p, s in signed.items()}, 3)
    assert {s: got.get(s, s) for s in want} == want


def test_star_contraction_on_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in common.connected(links, "a", "b").collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(600, 16))
    points[5] = points[9] = points[400]
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        scores = points @ points[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        assert sorted(found) == list(range(1, 21)) and all(abs(s - scores[v]) < 1e-12 for v, s in found.values())
        hits += len({v for v, _ in found.values()} & set(want))
    assert hits >= 0.9 * 20 * len(got)
    assert [found[1][0] for q, found in got.items() if q == 400] == [5]
    assert neighbours.nearest(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_neighbours_ties_go_to_smaller_ids(spark):
    """One hundred distinct vectors have the same product with the query; 25 rows of the query's id share its vector."""
    k = 20
    tied = [(1000 - i, [0.5] + [1.0 if j == i else 0.0 for j in range(100)]) for i in range(100)]
    got = neighbours.nearest(spark.createDataFrame([(5000, [1.0] + [0.0] * 100), *tied], "vec_id long, embedding array<double>"), F.col("id") == 5000, k=k, share=50.0)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == list(range(901, 901 + k))
    rows = [(1, [1.0, 0.0])] * 25 + [(2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 1, k=k, share=50.0)
    assert {r["vec_id"] for r in got.collect()} >= {2, 3}


def test_neighbours_search_follows_the_data(spark, monkeypatch):
    """Vectors in clusters need few rows opened; the pilot finds how many, and recall holds against brute force."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    asked = []
    least = neighbours.least_search

    def spied(*args):
        asked.append(least(*args))
        return asked[-1]

    monkeypatch.setattr(neighbours, "least_search", spied)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert asked[0][1] < 0.5 * len(points)
    hits = 0
    for q, found in got.items():
        scores = points @ points[q]
        scores[q] = -np.inf
        hits += len(found & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 200 and hits >= 0.9 * 20 * len(got)


def test_neighbours_common_vector_and_clashing_columns(spark):
    """A third of all rows hold one vector; extra columns carry the operator's own names; large leaves go in parts."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(900, 8))
    points[::3] = points[0]
    df = spark.createDataFrame([(i, x.tolist(), "a", 1, None) for i, x in enumerate(points)], "vec_id long, embedding array<double>, id string, vec int, mark double")
    few = F.col("id").isin(0, 1, 60)
    got = {}
    for r in neighbours.nearest(df, few, share=50.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, found in got.items():
        scores = np.round(points @ points[q], 9)
        assert [v for _, v in sorted(found)] == sorted((i for i in range(900) if i != q), key=lambda i: (-scores[i], i))[:20]
    assert set(got) == {0, 1, 60}
    assert neighbours.nearest(df, F.lit(False)).count() == 0


def test_neighbours_hits_do_not_grow_with_tasks(spark):
    """Half of all rows are near copies; the rows that leave the scoring tasks are a few hundred a query, however many tasks there are."""
    rng = np.random.default_rng(10)
    points = rng.normal(size=(3000, 16))
    points[::2] = points[0] + 0.01 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>")

    def made(plan):
        """Rows out of the scoring nodes of an executed plan."""
        name = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().apply("pythonNumRowsReceived").value() if name == "MapInArrowExec" and "score" in plan.toString().split("\n")[0] else 0
        return own + sum(map(made, below))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = neighbours.nearest(df, F.col("id") % 20 == 0)
        rows = found.collect()
        hits = made(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < hits < 150 * 200, hits
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    right = 0
    for q, own in got.items():
        scores = points @ points[q]
        scores[q] = -np.inf
        assert len(own) == 20 and all(abs(scores[v] - s) < 1e-9 for v, s in own.items())
        right += len(set(own) & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 150 and right >= 0.9 * 20 * 150


def test_bundles_hold_bounded_rows():
    sizes = np.array([3, 4, 5, 0, 25, 1, 10, 2])
    first, parts = neighbours.bundles(sizes, 10)
    assert first.tolist() == [0, 0, 1, 1, 2, 5, 6, 7] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_mix_meets_targets(docs, texts, empty):
    rows, pieces = mixing.mix(docs)
    got = mixing.taken(rows, pieces).collect()
    assert [r["size"] for r in sorted(got, key=lambda r: r["doc_id"])] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r["source"], [r["source_size"], r["target"], 0])[2] += r["taken"]
    assert all(taken == int(target) and target <= 2 * size for size, target, taken in per.values())
    assert sum(target for _, target, _ in per.values()) == pytest.approx(1.5 * sum(size for size, _, _ in per.values()))
    slots = pieces.select("slot", "source", "rank").distinct().collect()
    assert len(slots) == len({(s["source"], s["rank"]) for s in slots})
    assert mixing.taken(*mixing.mix(empty)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken for _, _, taken in per.values())


def test_language(spark, empty):
    rng = random.Random(1)
    kinds = {"aa": ["alpha", "banda", "canta", "manna"], "oo": ["folo", "gordo", "monto", "zolo"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k, None, 0, "a", "b", 1, "r") for i in range(120) for k in [("aa", "oo")[i % 2]]]
    rows += [(900, None, "aa", None, 0, "a", "b", 1, "r"), (901, "12 %% 34", None, None, 0, "a", "b", 1, "r"), (None, "folo gordo monto", None, None, 0, "a", "b", 1, "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == ("aa", "oo")[i % 2] and 0.5 < got[i]["score"] <= 1 for i in range(120))
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] == "oo"
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(empty).count() == 0
    assert {r["doc_id"] for r in langid.keep_identified(df).collect()} == set(range(120)) | {None}


def test_language_gradients():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(0)
    make = lambda *s: rng.normal(0, 0.5, s)
    d = langid.Direction(make(9, 256), make(9, 3))
    spans = rng.integers(97, 123, (7, 2)).astype(np.uint8)
    weight = make(7, 2, 3)
    run = lambda: np.float64((langid._run(d, spans) * weight).sum())
    kept = []
    langid._run(d, spans, kept)
    grads = langid._unroll(d, spans, kept, weight)
    for values, slopes in ((d.turn, grads.turn), (d.table, grads.table)):
        for at in [(0, 1), (4, 2), (8, 0)] if values is d.turn else [(r, spans[3, 0]) for r in (1, 4, 7)]:
            old = values[at]
            values[at] = old + 1e-2
            up = run()
            values[at] = old - 1e-2
            down = run()
            values[at] = old
            assert (up - down) / 2e-2 == pytest.approx(slopes[at], abs=5e-3)


def test_pages(spark):
    frame = '<html><head><title>t</title><script>x("</p>")</script></head><body><header>Site</header><div>Top menu</div><div id="c"><h2>{0} &amp; co</h2><p>Text  of\n{0}</p></div><div>Legal</div><div class="comments">No {0}</div></body></html>'
    rows = [(i, f"http://h.org/a/{i}", frame.format(n)) for i, n in enumerate(["one", "two", "three"])]
    rows += [(3, "http://h.org/a/0", rows[0][2]), (4, None, None), (5, "http://x.org", "<article><p>Own &lt;text&gt;<p>more</article><footer>f</footer>"), (None, "", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[3] == ("one & co\nText of one", 20)
    assert got[1][0] == "two & co\nText of two" and got[5] == ("Own <text>\nmore", 15) and got[4] == got[None] == ("", 0)


def _page_texts(spark, pages_of):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages_of)]
    return [r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_pages_difference_inside_articles(spark):
    """A block that every article repeats goes; a passage that two of ten articles share stays."""
    own = lambda i: f"<p>Report {i} tells of {i} ships, their {i} captains and what they carried to port {i}." * 2
    quote = "<p>A passage that both quote."
    got = _page_texts(spark, [(f"http://h.org/{i}", f"<main>{own(i)}{quote if i in (4, 5) else ''}<p>Read our letter</main>") for i in range(10)])
    line = "Report {0} tells of {0} ships, their {0} captains and what they carried to port {0}."
    assert got == ["\n".join([line.format(i)] * 2 + ["A passage that both quote."] * (i in (4, 5))) for i in range(10)]


def test_pages_lose_a_frame_larger_than_their_text(spark):
    """Seventy per cent of each page are an unmarked menu and footer."""
    menu, foot = "".join(f"<div>Menu entry number {k}</div>" for k in range(10)), "<div>All rights reserved by the house</div>"
    text = lambda i: f"Story {i} is short and has number {i} in it, {i} times over, and ends."
    got = _page_texts(spark, [(f"http://h.org/s/{i}", f"{menu}<p>{text(i)}</p>{foot}") for i in range(6)])
    assert got == [text(i) for i in range(6)]


def test_pages_pass_over_a_run_of_near_copies(spark):
    """Five versions of a page that differ in a date stand next to each other by URL."""
    menu = "".join(f"<div>Menu entry number {k}</div>" for k in range(4))
    body = [f"Paragraph {k} of the long text tells at some length what happened on day {k} of the voyage." for k in range(8)]
    page = lambda date, lines: f"{menu}<p>{date}</p>" + "".join(f"<p>{x}</p>" for x in lines)
    other = [[f"Tale {i} speaks of other matters, {k} in number, and of {i} things." for k in range(5)] for i in range(3)]
    pages_of = [(f"http://h.org/m/print{i}", page(f"Day {i}", body)) for i in range(5)]
    pages_of += [(f"http://h.org/{c}", page(f"Seen {i}", other[i])) for i, c in enumerate("ayz")]
    got = _page_texts(spark, pages_of)
    assert got == ["\n".join([f"Day {i}", *body]) for i in range(5)] + ["\n".join([f"Seen {i}", *other[i]]) for i in range(3)]


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar"><article>{}</article></div>', '<main class="content-with-sidebar">{}</main>', '<div id="social-site"><article>{}</article></div>',
    '<form action="/p.aspx"><article>{}</article></form>', '<form action="/p.aspx"><div>{}</div></form>', '<div class="layout has-sidebar">{}</div>', '<div class="widget"><main>{}</main></div>',
])
def test_page_wrappers_hold_text(wrapper):
    lines = pages.body_lines(wrapper.format("<h1>Title</h1><p>Some text</p>"))
    assert pages.text_lines(lines, 0) == ["Title", "Some text"]


def test_page_parts_beside_text():
    beside = '<div class="site-footer">a</div><div class="ad-slot-1">b</div><ul id="mainMenu"><li>c</ul><form><label>d</label><p></form><div class="comment-list"><article><p>e</p></article></div><aside><article>f</article></aside>'
    assert pages.text_lines(pages.body_lines(f"<p>Text</p>{beside}<p>more"), 0) == ["Text", "more"]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = pages.aligned(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(any(y == a[i] for y in rest) for i in found)


def test_license_scan(spark, empty):
    long = licenses.TEMPLATES["mit-grant"]
    words = long.split()
    words[40] = "changed"
    rows = [(1, "x " * 50 + "Released under the MIT License. y"), (2, "z " * 77 + long), (3, "q " * 30 + " ".join(words)), (4, long[: len(long) // 2]), (5, None), (None, "licensed UNDER cc-by-nc 4.0")]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop((3, "mit-grant")) == pytest.approx(1 - 5 / (len(re.findall("[A-Za-z0-9]+", long)) - 4))
    assert got == {(1, "mit-name"): 1.0, (2, "mit-grant"): 1.0, (None, "cc-by-nc-4.0-name"): 1.0}
    assert licenses.scan(empty).count() == 0


def scan_oracle(rows, templates):
    """(doc, license, matched, first shingle) by reading every window."""
    def shingles(text):
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", text or "")]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = set()
    for name, text in templates.items():
        wanted = set(shingles(text))
        half = 1 << (len(wanted) - 1).bit_length()
        for doc, held in ((doc, shingles(body)) for doc, body in rows):
            found = [(len(wanted & set(held[s : s + 2 * half])), -s) for s in range(0, len(held), half)]
            if found and wanted and max(found)[0] >= 0.8 * len(wanted):
                out.add((doc, name, max(found)[0], -max(found)[1]))
    return out


def test_license_templates_from_files(spark, tmp_path):
    """Whole texts read as a table: ties between windows, repeated rows, very long texts, edits; a short template gives nothing."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    templates = {name: " ".join(rng.choice(words) for _ in range(n)) for name, n in (("Long-1.0", 1500), ("mid b", 130), ("six", 6), ("tiny", 4))}
    for name, text in templates.items():
        (tmp_path / (name + (".txt" if name != "six" else ""))).write_text(text)
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cut = lambda text, every: " ".join("edited" if i % every == 0 else w for i, w in enumerate(text.split(), 1))
    rows = [
        (1, noise(77) + " " + templates["Long-1.0"] + " " + noise(9)), (2, noise(40_000) + "\n" + templates["mid b"].upper() + "\n" + noise(30_000)),
        (3, f"{templates['mid b']} {noise(600)} {templates['mid b']}"), (4, cut(templates["Long-1.0"], 30)), (5, cut(templates["Long-1.0"], 12)), (6, templates["six"]),
        (6, templates["six"]), (7, templates["tiny"]), (8, None), (9, ""),
    ]
    table = licenses.read_templates(spark, str(tmp_path))
    extra = table.withColumn("n", F.lit(1)).unionByName(spark.createDataFrame([(None, "a b c d e f", 1), ("none", None, 1)], "license string, text string, n int"))
    docs = spark.createDataFrame([(*r, "x", 2, "y") for r in rows], "doc_id long, text string, license string, n int, h string")
    got = licenses.scan(docs, extra).collect()
    assert {(r["doc_id"], r["license"], r["matched"], r["first_shingle"]) for r in got} == scan_oracle(rows, templates) and len(got) == 5
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 6}


def test_license_texts_find_themselves(spark):
    rows = list(licenses.TEMPLATES.items())
    got = licenses.scan(spark.createDataFrame([(i, f"Copyright held by us. {text} End of it.") for i, (_, text) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {(rows[r["doc_id"]][0], r["license"], r["matched"]) for r in got} == {(rows[d][0], name, m) for d, name, m, _ in scan_oracle([(i, t) for i, (_, t) in enumerate(rows)], licenses.TEMPLATES)}


def repeats_oracle(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if d else 0, bytes(b for b, g in zip(d, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("together", [50_000, 2])
def test_repeated_strings(docs, texts, empty, together):
    got = by_id(substrings.remove_repeats(docs, together=together))
    assert [(got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) for i in range(len(texts))] == repeats_oracle(texts, substrings.LENGTH)
    assert substrings.remove_repeats(empty).count() == 0


def test_repeated_strings_inside_one_text(spark):
    text = "ab" * 300 + "é" * 250 + "c" * 399
    rows = spark.createDataFrame([(1, text), (None, "c" * 399)], "doc_id long, text string")
    got = by_id(substrings.remove_repeats(rows))
    assert [(got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) for i in (1, None)] == repeats_oracle([text, "c" * 399], 400)


def test_reach_of_many_contexts_equals_that_of_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 99, 40).astype(np.uint8)
    left, right = np.tile(base[:16], (60, 1)), np.tile(base[16:40], (60, 1))
    for rows in (left, right):
        for row in rows:
            row[rng.integers(0, len(row)) :] = rng.integers(97, 99)
    before, after = rng.integers(8, 17, 60), rng.integers(12, 25, 60)
    most, far = substrings.shared_reach(left, right, before, after, 20)
    for i in range(60):
        reach = [(-1, -1)]
        for j in range(60):
            same = [int(min(np.argmin(np.append(a[i] == a[j], False)), n[i], n[j])) for a, n in ((left, before), (right, after))]
            if i != j and sum(same) >= 20:
                reach.append((min(same[0], 16), min(same[1], 20)))
        assert (most[i], far[i]) == (max(r[0] for r in reach), max(r[1] for r in reach))


def test_fingerprints(docs, texts, empty):
    got = by_id(fingerprints.fingerprint_edits(docs))
    known = [t or "" for t in texts]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)) if w}
    off = []
    for i, t in enumerate(known):
        after, m = known[(i + 1) % len(known)], len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, column in ((edited, "near_edited"), (after, "near_next")):
            a, b = shingles(t), shingles(other)
            off.append(abs(got[i][column] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(off) < 0.04 and max(off) < 0.25
    same = {}
    for i, t in enumerate(known):
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_fingerprint_bins_are_filled_row_by_row(spark):
    """A text's minima need no aggregate over rows of shingles; empty bins take the first full one of their order, however few are full."""
    rng = random.Random(8)
    texts = ["", " ", "one", "One two", *(" ".join(f"w{rng.randint(0, 500)}" for _ in range(n)) for n in (5, 6, 9, 20, 60, 200, 900, 3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    found = fingerprints.minima(docs, ["doc"], "text")
    assert "Aggregate" not in found._jdf.queryExecution().sparkPlan().toString()
    dense = {r["doc"]: r["v"] for r in found.select("doc", fingerprints.densified(F.col("minima")).alias("v")).collect()}
    order = spark.range(128).select(F.col("id").cast("int").alias("j")).crossJoin(spark.range(128).select(F.col("id").cast("int").alias("m"))).select("j", "m", F.xxhash64("j", "m").alias("h")).collect()
    turn = {(r["j"], r["m"]): r["h"] for r in order}
    hashed = fingerprints.with_shingles(docs, "text", "s", 5).select("doc", F.explode("s").alias("s")).select("doc", F.xxhash64(*[F.col(f"s.w{i}") for i in range(5)]).alias("h")).collect()
    for i in range(len(texts)):
        least = {}
        for r in hashed:
            if r["doc"] == i:
                m, v = r["h"] % 128, (r["h"] % 2**64) >> 7
                least[m] = min(v, least.get(m, v))
        want = [least[j] if j in least else least[min(least, key=lambda m: (turn[j, m], m))] for j in range(128)] if least else []
        assert dense[i] == want, texts[i][:40]
