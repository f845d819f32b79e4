"""Every operator against a plain version, on a fixture with nulls, empty and long texts, ties, repeated rows, odd columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from calltally.llm import fingerprints, jaccard_join, line_dedup, packing, pii, quality, rolling, sentencepiece_sampling, sharding, substring_dedup, url_filters
from calltally.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, row string, _k long, b string"


def _texts():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ünï", "𝛼β"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(150), prose(60)
    out = [None, "", " \t\n", "one", "One", "two words", "Two  words", "a b c", "a b c d", "a b c d e", prose(34), prose(35), base, base, base.upper()]
    for edits in (1, 1, 1, 2, 2, 3, 4, 6, 9):
        w = base.split()
        for _ in range(edits):
            w[r.randrange(len(w))] = r.choice(vocabulary) + "x"
        out.append(" ".join(w))
    out += [prose(40) + " " + passage + "\n" + prose(r.randrange(5, 90)) for _ in range(12)]
    out += [f"{prose(8)}\n  Shared Line {'' if i % 2 else ' '}\n\n{prose(5)}\nSHARED LINE" for i in range(11)]
    out += ["x " * 300, "spam ham eggs " * 40, prose(9000), "\n".join(["same"] * 30), "a\rb\x0bc\x0cd", "no\u00a0break\u2003space"]
    out += [" ".join(f"s{j}" for j in range(i, i + 16)) for i in range(6)]
    out += ["mail a.b@c-d.example.com, 10.0.0.256 10.0.0.25, 4111 1111 1111 1111 +1 (415) 555-0100.", "x@y z@w.v_q@r.s 1.2.3.4.5.6.7.8 é 4111-1111-1111-1112", "9" * 5000 + " +123 +12345678901234567"]
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], "src0" if i % 2 else None, None if t is None else len(t), i, "r", 1, "b") for i, t in enumerate(texts)]
    rows += [rows[20], (None, texts[21], "en", "src0", 1, 0, "r", 1, "b"), (None, texts[21], "en", "src0", 1, 0, "r", 1, "b")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_substring_dedup(docs, plain, none):
    for width in (35, 8, 2):
        got = [tuple(r) for r in substring_dedup.mark_repeats(docs, width).collect()]
        same(got, [(d, *x) for (d, _), x in zip(plain, brute.substring_dedup([t for _, t in plain], width), strict=True)])
    assert substring_dedup.mark_repeats(none).count() == 0


def test_packed_lists():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        v = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (rolling.decode(rolling.encode(v)) == v).all()
    w = rolling.Words(__import__("pyarrow").array(["a b", None, "", "b  a\tb"]))
    assert w.counts.tolist() == [2, 0, 0, 3] and w.h[1] == w.h[2] == w.h[4] and w.h[0] == w.h[3] != w.h[1]


def test_line_dedup(docs, plain, none):
    for k in (2, 10):
        got = [(r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs, k).collect()]
        same(got, [(d, *x) for (d, _), x in zip(plain, brute.line_dedup([t for _, t in plain], k), strict=True)])
    out = line_dedup.without_frequent_lines(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text) and doc_id is not null").count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_jaccard_join(docs, plain, none):
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs, n, percent).collect()]
        same(got, [(d, *x) for (d, _), x in zip(plain, brute.components([t for _, t in plain], [d for d, _ in plain], n, percent), strict=True)])
    assert jaccard_join.link_documents(none).count() == 0


def test_jaccard_join_with_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base, texts = [f"b{i}" for i in range(90)], []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 2, 3, 5, 8))):
            w[r.randrange(90)] = f"e{r.randrange(60)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{i}_{j}" for j in range(25)) + " " + " ".join(base[:60]) for i in range(80)]
    texts += [" ".join(f"t{j}" for j in range(i, i + 15)) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(df).collect()]
    same(got, [(i, *x) for i, x in enumerate(brute.components(texts, list(range(len(texts))), 4, 85))])


def test_lists_of_many_components_are_split(spark, monkeypatch):
    """Documents of shared blocks: every list holds many that don't link, and some that do without their list's pivot."""
    r = random.Random(12)
    blocks = [" ".join(f"k{b}_{j}" for j in range(12)) for b in range(14)]
    texts = [" ".join(blocks[b] for b in sorted(r.sample(range(14), 6))) for _ in range(150)]
    for t in list(texts[::3]):
        w = t.split()
        w[r.randrange(len(w))] = "x"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute.components(texts, list(range(len(texts))), 4, 85))]
    levels = []
    split = jaccard_join._split_lists
    monkeypatch.setattr(jaccard_join, "_split_lists", lambda rows, tokens, level, percent: levels.append(level) or split(rows, tokens, level, percent))
    for most in (4096, 4):
        levels.clear()
        monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most)
        same([(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.link_documents(df).collect()], want)
        assert bool(levels) == (most < 64)


def test_small_sets_link_by_their_subsets(spark):
    r = random.Random(13)
    texts = [" ".join(f"s{j}" for j in range(i, i + r.randrange(9, 14))) for i in range(0, 400, 2)]
    texts += [t + " more" for t in texts[::4]] + ["first " + t for t in texts[::5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute.components(texts, list(range(len(texts))), 4, 85))]
    same([(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.link_documents(df).collect()], want)
    sets = jaccard_join.shingle_sets(df, 4, 85, "doc_id", "text").cache()
    from pyspark.sql import functions as F

    lists = sets.select("node", "n", F.explode("list").alias("e")).select("node", "n", "e.token", "e.pos")
    most = jaccard_join.boundary(sets, lists, 85)
    assert most >= 7 and jaccard_join._subset_links(sets, most, 85).count() > 20


def test_small_sets_meet_in_subsets():
    assert jaccard_join.least_overlap(13, 13, 85) == 12 and jaccard_join.least_overlap(7, 7, 85) == 7
    assert jaccard_join.subset_cost(13, 85) > 13 and jaccard_join.prefix_length(20, 85) == 4


def test_near_duplicate_stage(docs, plain):
    out = jaccard_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    want = brute.components([t for _, t in plain], [d for d, _ in plain], 5, 80)
    assert sorted(d for d, t in kept if brute.shingles(t, 5)) == sorted({c for (d, t), (n, c) in zip(plain, want, strict=True) if n})
    assert sum(not brute.shingles(t, 5) for _, t in kept) == sum(not brute.shingles(t, 5) for _, t in plain)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)] + [(200, i) for i in range(201, 260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_personal_data(docs, plain, none):
    got = [(r.row.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in pii.find_personal_data(docs).collect()]
    same(got, [(d, sorted(brute.personal(t), key=lambda x: (pii.KINDS.index(x[0]), x[1]))) for d, t in plain])
    assert pii.find_personal_data(none).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(plain)
    left = [r.text for r in out.collect() if brute.personal(r.text)]
    assert not left


def test_context_finds_identifiers_that_no_pattern_has(spark):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "the", "sit"]) for _ in range(n))
    rows = [f"{words(9)} Telephone: +1 (415) 555-{1000 + i} {words(9)} the +1 (212) 555-{2000 + i} {words(4)}" for i in range(20)]
    rows += [f"{words(5)} telephone: 0151-{2345 + i}-778, {words(5)} the 2024-{10 + i}-99 {words(3)}" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    more = {r.row.doc_id: [r.row.text[s.start : s.end] for s in r.spans if not s.base] for r in pii.find_personal_data(df).collect()}
    assert {d: x for d, x in more.items() if x} == {20 + i: [f"0151-{2345 + i}-778"] for i in range(4)}


def test_context_counts_repeated_rows_once_and_takes_any_label(spark, monkeypatch):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "the", "sit"]) for _ in range(n))
    marks = ("Telephone: ", "T\u00e9l\u00e9phone:", "tel2 ")
    seeds = [f"{words(9)} {m}+1 (415) 555-{1000 + i} {words(9)}" for m in marks for i in range(20)]
    rows = list(enumerate(seeds + [f"{words(5)} {m}0151-{2345 + i}-778, {words(5)}" for i, m in enumerate(marks)]))
    for all_rows in (rows, rows + rows, rows + rows[60:61] * 50):
        for most in (pii.MAX_BROADCAST_REPEATS, 1):
            monkeypatch.setattr(pii, "MAX_BROADCAST_REPEATS", most)
            df = spark.createDataFrame(all_rows, "doc_id long, text string")
            more = {x.row.doc_id: [x.row.text[s.start : s.end] for s in x.spans if not s.base] for x in pii.find_personal_data(df).collect()}
            assert {d: x for d, x in more.items() if x} == {60 + i: [f"0151-{2345 + i}-778"] for i in range(3)}


def test_statistics(docs, plain, none):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge_quality(docs).collect()]
    same(got, [(d, *brute.statistics(t)) for d, t in plain])
    assert quality.judge_quality(none).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(4)
    words = [f"word{i}" for i in range(900)]
    clean = [" ".join(r.choice(words) for _ in range(r.randrange(60, 300))) for _ in range(300)]
    junk = [" ".join(r.choice(words) + "***" for _ in range(120)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.filter_quality(df).collect()}
    assert kept == set(range(300))
    few = df.where("doc_id < 10")
    assert quality.filter_quality(few).count() == 10  # too few for estimates of their own


def test_estimates_are_those_of_many_random_starts(spark):
    g = np.random.default_rng(8)
    groups = {}
    for name, share, shift in (("clean", 0.0, 0), ("far", 0.2, 9), ("cluster", 0.23, 4), ("flat", 0.1, 6)):
        mix = g.normal(size=(5, 5)) + 2 * np.eye(5)
        x = g.normal(size=(500, 5)) @ mix.T + g.normal(size=5) * 10
        if name == "flat":
            x[:, 3] = 1.0
        n = int(share * 500)
        x[:n] += shift * (np.abs(x).std(0) + 0.3) * np.array([1, -1, 1, 1, -1]) + g.normal(size=(n, 5)) * 0.1
        groups[name] = x
    rows = [("en", name, *map(float, v)) for name, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "_lang string, _source string, " + ", ".join(f"x{i} double" for i in range(5)))
    for few in (True, False):
        got = {r._source: r for r in quality.minimum_covariance(df, few).collect()}
        for name, x in groups.items():
            m, c, scale = brute.minimum_covariance(x, quality.SUPPORT, quality.FLOOR, quality.MAX_SCALE, quality.CHI2_MEDIAN, quality.CHI2_INNER)
            own = got[name]
            low = np.array([[own[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
            off = np.array([own[f"m{i}"] for i in range(5)]) - m
            assert off @ np.linalg.inv(c) @ off < 0.02 and abs(np.linalg.slogdet(low @ low.T)[1] - np.linalg.slogdet(c)[1]) < 0.35 and abs(own.scale / scale - 1) < 0.15
            d2 = lambda mean, cov, k, x=x: k * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            far = d2(m, c, scale) > 40
            assert (far == (d2(m + off, low @ low.T, own.scale) > 40)).mean() > 0.99 and far.sum() >= 98 * (name == "far")


def test_outliers_of_small_groups_go(spark):
    r = random.Random(5)
    words = [f"word{i}" for i in range(900)]
    text = lambda mark="": " ".join(r.choice(words) + mark for _ in range(r.randrange(60, 300)))
    rows = [(text(), "en", f"s{i % 30}") for i in range(300)] + [(text(), "xx", "s0") for _ in range(5)]  # 10 to a source, 5 to a language
    rows += [(text("***"), "en", "s3"), (text("***"), "en", "own"), (text("***"), "xx", "s0"), (text("***"), None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = quality.judge_quality(df).collect()
    assert {x.doc_id for x in out if not x.kept} == set(range(305, 309)) and all(x.distance is not None for x in out)
    few = df.where("doc_id < 20 OR doc_id = 305")  # fewer in the whole corpus than a group needs
    assert {x.doc_id for x in quality.judge_quality(few).collect() if not x.kept} == {305}


def test_an_outlier_in_each_statistic_goes(spark):
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(100_000):05d}" for _ in range(n)]
    rows = [" ".join(words(r.randrange(60, 300))) for _ in range(200)]
    rows += ["\n".join([" ".join(words(20)), x := " ".join(words(8)), x, " ".join(words(20))]) for _ in range(3)]  # one repeated line stays
    lines, seen, few = words(2), set(), words(20)
    while len(lines) < 150:  # lines of one word, no three of them twice
        w = r.choice(few)
        if (*lines[-2:], w) not in seen:
            seen.add((*lines[-2:], w))
            lines.append(w)
    passage = words(48)
    rows += [" ".join(words(60_000)), " ".join(w * 10 for w in words(120)), " ".join(w + "***" for w in words(120)), "\n".join(lines), " ".join(passage + words(104) + passage)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = {x.doc_id: x for x in quality.judge_quality(df).collect()}
    assert not any(x.base_failed for x in out.values()) and (out[206].n_repeat_words, out[207].n_dup_lines) == (0, 0)
    assert {i for i, x in out.items() if not x.kept} == set(range(203, 208))


def test_packing(docs, plain, none, spark, monkeypatch):
    encode = packing.encoder(packing.VOCABULARY)
    ids = {(d, t): np.array([*encode(t or ""), 1], "<u4") for d, t in plain}
    for lot in (packing.LOT_TOKENS, 3000):
        monkeypatch.setattr(packing, "LOT_TOKENS", lot)
        for rows in (packing.pack_documents(docs, with_ids=True).collect(), packing.pack(packing.tokenize(docs), with_ids=True).collect()):
            of, pieces = defaultdict(list), defaultdict(list)
            for r in rows:
                pieces[r.sequence_id].append(r)
                of[r.doc_id].append(r)
                assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
            for own in pieces.values():
                own.sort(key=lambda r: r.offset)
                assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and len(own) <= packing.MAX_SEGMENTS
                n = sum(r.length for r in own)
                assert n == 2048 or n & (n - 1) == 0
                assert sum(r.length - r.no_loss for r in own) <= packing.MAX_LOSS_TOKENS
            for d, t in plain:
                if sum(x == d for x, _ in plain) == 1:
                    own, x = sorted(of[d], key=lambda r: r.start), ids[(d, t)]
                    assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
                    assert b"".join(r.ids for r in own) == x.tobytes() and own[0].doc_tokens == len(x)
                    assert sum(r.no_loss for r in own) == 256 * (len(x) // 2048) + min(256, len(x) % 2048 // 4)
            assert sum(r.length for r in rows) == sum(len(ids[x]) for x in plain)
    assert packing.pack_documents(none).count() == 0
    lead = spark.createDataFrame([(1, np.arange(3000, dtype="<u4").tobytes(), 1000), (2, b"", 5), (3, None, None), (4, np.arange(70, dtype="<u4").tobytes(), None)], "doc_id long, ids binary, lead int")
    rows = packing.pack(lead, lead_col="lead").collect()
    assert {d: (sum(r.length for r in rows if r.doc_id == d), sum(r.no_loss for r in rows if r.doc_id == d)) for d in (1, 2, 3, 4)} == {1: (3000, 1000), 2: (0, 0), 3: (0, 0), 4: (70, 0)}


def test_bins_are_those_of_a_plain_version():
    r = random.Random(11)
    for _ in range(60):
        n, limits = r.randrange(0, 60), (r.choice((16, 50, 64)), r.choice((2, 5, 64)), r.choice((7, 30, 64)))
        sizes = [r.choice((0, 1, 3, 3, 8, 15, 30, 49, 70, 200)) + r.randrange(3) for _ in range(n)]
        lead = [r.randrange(0, s + 9) if r.random() < 0.7 else 0 for s in sizes]
        assert packing.fill(sizes, lead, *limits) == brute.fill(sizes, lead, *limits)
    parts = [x for _ in range(2000) for x in packing.stretches(int(r.lognormvariate(6, 1.5)) + 1, None, 2048)]
    bins = packing.fill([n for _, n, _ in parts], [q for *_, q in parts], 2048, 64, 1792)
    loss = [sum(n - max(0, min(n, parts[i][2] - s)) for i, s, n in b) for b in bins]
    assert max(loss) == 1792 and sum(sum(n for *_, n in b) == 2048 for b in bins) > 0.99 * len(bins)  # the limit binds, and bins are full


def test_ids_are_those_of_the_json_vocabulary(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.VOCABULARY)
    for x in [*filter(None, texts), "  two  spaces\n\n\n it's 12,345 ", "tabs\t\t\r\n…“ ”"]:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.VOCABULARY)
    cases = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext |>", "<|endoftext|"]
    for x in cases:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert encode(cases[0]).tolist() == [64, 220, 50256, 275]
    rows = packing.pack_documents(spark.createDataFrame([(1, cases[0])], "doc_id long, text string"), with_ids=True).collect()
    assert [x for r in sorted(rows, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()] == [64, 220, 50256, 275, 1]


def test_vector_limits():
    bins = packing.fill([100, 900, 30, 4000, 0, 512], [90, 0, 0, 1000, 0, 512], 1024, 3, 600)
    taken = defaultdict(list)
    for b in bins:
        assert sum(n for *_, n in b) <= 1024 and len(b) <= 3
        loss = sum(max(0, s + n - max(s, [90, 0, 0, 1000, 0, 512][i])) for i, s, n in b)
        assert loss <= 600
        for i, s, n in b:
            taken[i].append((s, n))
    for i, size in enumerate([100, 900, 30, 4000, 0, 512]):
        at = 0
        for s, n in sorted(taken[i]):
            assert s == at
            at += n
        assert at == size


def test_sharding(docs, plain, none):
    rows = sharding.assign_shards(docs).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in plain])
    slots, shard = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert sharding.assign_shards(none).count() == 0


def test_weighted_shares(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select(sharding.shard_of(F.col("id"), [1.0, 2.0, 5.0]).alias("s"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(n[0] / 20000 - 0.125) < 0.01 and abs(n[2] / 20000 - 0.625) < 0.015


def test_fingerprints(docs, plain, none):
    rows = fingerprints.fingerprint_edits(docs).collect()
    ordered = sorted(((d, t or "") for d, t in plain if d is not None), key=lambda x: -x[0]) + [(None, t or "") for d, t in plain if d is None]
    want = []
    for (d, t), (_, u) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        m = len(t) // 3
        want.append((d, len(t), brute.sha(t[: len(t) - m] + u[:m])))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in rows], want)
    of = {d: t or "" for d, t in plain}
    mark: dict = {}
    for r in rows:
        assert mark.setdefault(of[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(mark.values())) == len(mark)
    assert fingerprints.fingerprint_edits(none).count() == 0
    assert fingerprints.fingerprint_edits(docs.where("doc_id = 12")).first().near_next == 1.0


def test_prefix_hashes_answer_spans_and_extensions():
    r = random.Random(9)
    a = "".join(r.choice("abé𝛼 ") for _ in range(700))
    b = a[100:300] + "#" + a[50:400]
    x, y = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for _ in range(300):
        i, j = r.randrange(len(a)), r.randrange(len(b))
        n = r.randrange(0, min(len(a) - i, len(b) - j) + 1)
        assert fingerprints.spans_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        e = 0
        while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
            e += 1
        assert fingerprints.longest_common_extension(x, i, y, j) == e
    assert fingerprints.longest_common_extension(x, 100, y, 0) == 200
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(a), f(a[:500] + "z" * 200)) > 0.6 > 0.1 > fingerprints.likeness(f(a), f("q" * 700))


def test_url_filters(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com/en/8", "ftp://x.net/de/1", "x://example.net/de/85#t", "http://notexample.net/de/8", "http://org/es/", "http://org/es", None, "", "nourl", "http://", "http://com/en/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    want = ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None, "com/en/"]
    for out in (url_filters.judge_urls(df), url_filters._judge_by_join(df, spark.createDataFrame(url_filters.RULES, "action string, host string, path string"), "url", "allow")):
        got = {r.row.page_id: (r.rule, r.verdict) for r in out.collect()}
        action = {h + p: a for a, h, p in url_filters.RULES}
        assert got == {i: (w, action.get(w, "allow")) for i, w in enumerate(want)}
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_a_very_long_url_is_looked_up_at_once(spark):
    import time

    trie = url_filters.build_trie(url_filters.RULES)
    began = time.time()
    for path in ("/en/7" + "x" * 1_000_000, "/" + "x" * 1_000_000, "/x" * 500_000):
        url_filters.lookup(trie, "a.example.com", path)
    assert time.time() - began < 1 and url_filters.lookup(trie, "a.example.com", "/en/7" + "x" * 1_000_000) == ("example.com/en/7", "allow")
    df = spark.createDataFrame([(0, "http://example.com/en/7" + "y" * 300_000), (1, None)], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "action string, host string, path string")
    assert {r.row.page_id: r.rule for r in url_filters._judge_by_join(df, rules, "url", "allow").collect()} == {0: "example.com/en/7", 1: None}


def test_rules_of_any_host_hold_beyond_the_bound_too(spark, monkeypatch):
    rules = [("block", "", "/en/long/"), ("allow", "com", "/en/"), ("block", "", "/")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.com/en/long/x", "http://a.net/en/long/x", "http://a.net/", "http:///x", "http://a.net"])], "page_id long, url string")
    out = []
    for most in (url_filters.MAX_BROADCAST_RULES, 1):
        monkeypatch.setattr(url_filters, "MAX_BROADCAST_RULES", most)
        out.append({r.row.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()})
    assert out[0] == out[1] and out[1][0] == ("com/en/", "allow") and out[1][1] == ("/en/long/", "block")


def test_sampled_segmentations(docs, plain, none):
    samples = sentencepiece_sampling.encode_samples(docs, 3)
    rows = sentencepiece_sampling.decode_samples(samples).collect()
    of, seen = dict(plain), defaultdict(list)
    for r in rows:
        assert r.decoded == (of[r.doc_id] or "")
        assert r.log_prob <= 0 and r.log_inclusion <= 0
        seen[r.doc_id].append(r)
    for d, own in seen.items():
        own.sort(key=lambda r: r.sample)
        if sum(x == d for x, _ in plain) == 1:
            assert len({bytes(r.ids) for r in own}) == len(own) and [r.sample for r in own] == list(range(len(own)))
            assert all(a.perturbed >= b.perturbed for a, b in zip(own, own[1:], strict=False))
    assert len(seen) == len(of)
    again = {(r.doc_id, r.sample, bytes(r.ids)) for r in sentencepiece_sampling.encode_samples(docs.repartition(2), 3).collect()}
    assert again == {(r.doc_id, r.sample, bytes(r.ids)) for r in rows}
    assert sentencepiece_sampling.encode_samples(none).count() == 0


def sentence_parts(text):
    """A text's words with the marks before them, and its line breaks."""
    import re

    return re.findall("▁*[^▁\n]+|▁+|\n", "▁" + text.replace(" ", "▁"))


def test_samples_follow_the_distribution_without_replacement():
    import math

    v = sentencepiece_sampling.vocabulary()
    look = {p: i for i, p in enumerate(v.pieces) if i >= 259}

    def all_paths(t, ids=(), w=0.0):
        if not t:
            yield ids, w
        for j in range(1, len(t) + 1):
            if (p := look.get(t[:j])) is not None:
                yield from all_paths(t[j:], (*ids, p), w + v.weight[p])

    for text in ("then", "a\nof the", "on  it"):
        parts = sentence_parts(text)
        paths = {(): 0.0}
        for part in parts:
            ways = dict(all_paths(part)) if part != "\n" else {(int(v.byte_id[10]),): float(v.weight[v.byte_id[10]])}
            paths = {a + b: x + y for a, x in paths.items() for b, y in ways.items()}
        total = math.log(sum(math.exp(w) for w in paths.values()))
        p = {k: math.exp(w - total) for k, w in paths.items()}
        n = 4000
        found = sentencepiece_sampling.sample_batch([text] * n, np.arange(n) * 7919, 2, v)
        ids = [tuple(found.ids[a:b].tolist()) for a, b in zip(found.at[:-1], found.at[1:], strict=True)]
        assert all(abs(math.exp(x) - p[i]) < 1e-9 for x, i in zip(found.log_prob, ids, strict=True))
        first, second = (Counter(i for i, s in zip(ids, found.sample, strict=True) if s == k) for k in (0, 1))
        for k, q in p.items():
            later = sum(p[a] * q / (1 - p[a]) for a in p if a != k)
            assert abs(first[k] / n - q) < 0.035 and abs(second[k] / n - later) < 0.035
        # Inclusion scores are those of a conditional Poisson design: dividing by them gives sums over all paths their value.
        weight = sum(math.exp(x - y) for x, y in zip(found.log_prob, found.inclusion, strict=True)) / n
        assert abs(weight - 1) < 0.1


def test_all_segmentations_come_where_more_are_asked_for():
    v = sentencepiece_sampling.vocabulary()
    found = sentencepiece_sampling.sample_batch(["to", "", "\U0001fad8"], np.array([1, 2, 3]), 50, v)
    look = {p: i for i, p in enumerate(v.pieces) if i >= 259}

    def count(t):
        return 1 if not t else sum(count(t[j:]) for j in range(1, len(t) + 1) if t[:j] in look)

    n = Counter(found.text.tolist())
    assert n == {0: count("▁to"), 1: 1, 2: 1}
    ids = [tuple(found.ids[a:b].tolist()) for a, b in zip(found.at[:-1], found.at[1:], strict=True)]
    assert len(set(ids[: n[0]])) == n[0] and found.inclusion.tolist() == [0.0] * len(ids)
    assert len(ids[-1]) == 1 + 4  # the mark and four bytes


def test_words_that_are_forgotten_give_the_same(monkeypatch):
    v = sentencepiece_sampling.vocabulary()
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("aeioustrn") for _ in range(r.randrange(1, 9))) for _ in range(30)) for _ in range(20)]
    key = np.arange(20)
    whole = sentencepiece_sampling.sample_batch(texts, key, 3, v)
    monkeypatch.setattr(sentencepiece_sampling, "KEPT_CHARS", 200)
    monkeypatch.setattr(sentencepiece_sampling, "ADDED_CHARS", 50)
    sentencepiece_sampling.lattices(v).forget()
    alone = [sentencepiece_sampling.sample_batch(texts[i : i + 1], key[i : i + 1], 3, v) for i in range(20)]
    assert whole.ids.tolist() == [x for a in alone for x in a.ids.tolist()]
    assert whole.perturbed.tolist() == [x for a in alone for x in a.perturbed.tolist()]


def test_pipeline(spark, docs, plain, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = stage.collect()
        after = f(spark, stage, str(tmp_path))
        if i < 4:
            assert after.columns == stage.columns
        rows = after.collect()
        if i == 0:
            kept = {r.doc_id for r in rows}
            assert kept == {r.doc_id for r in before if (s := brute.statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}  # groups too small for outliers
        if i == 1:
            want = brute.line_dedup([r.text for r in before], 10)
            same([(r.doc_id, r.text) for r in rows], [(r.doc_id, w[2]) for r, w in zip(before, want, strict=True)])
        if i == 2:
            want = brute.components([r.text for r in before], [r.doc_id for r in before], 5, 80)
            assert {r.doc_id for r in rows} == {c for _, c in want}
        if i == 3:
            assert len(rows) == len(before) and not any(brute.personal(r.text) for r in rows)
        if i == 4:
            encode = packing.encoder(packing.VOCABULARY)
            assert sum(r.length for r in rows) == sum(len(encode(r.text or "")) + 1 for r in before)
        stage = after if i == 4 else spark.createDataFrame(rows, stage.schema)
    # Which pieces share a sequence depends on how the rows lie in partitions; the documents' tokens don't.
    tokens = lambda pieces: [(d, n, sum(r.length for r in pieces if r.doc_id == d)) for d, n in {(r.doc_id, r.doc_tokens) for r in pieces}]
    same(tokens(corpus_pipeline.run(spark, str(tmp_path)).collect()), tokens(rows))
