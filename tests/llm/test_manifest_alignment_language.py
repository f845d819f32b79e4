"""The manifest, the alignment of tokenizers and language ID against plain versions, on rows with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from calltally.llm import alignment, language_id, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, row string, path string, c0 int"
SF = "/root/testdata/sf0.001"


def _texts():
    r = random.Random(3)
    words = ["one", "Two", "drei", "été", "niño", "groß", "x1", "don't", "a-b", "(c)", "…", "日本語", "😀", "ab\ncd", "naïve"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [None, "", " ", "\n", "a", "  two  spaces ", " lead", "trail ", "tab\t x", "a \n b", "no break 　 wide", "▁literal piece", "a ▁b c", "<s> </s> <unk> <|endoftext|>", "x\x00y \x1c z"]
    out += ["a" * 5000, " " * 3000, "ab " * 700, "́é e", "".join(chr(0x4E00 + i * 7) for i in range(900)), "12345 67890 " * 20, "don't won't I'll WE'RE", "\r\n\r\n  \t x", "\u0085   z"]
    out += [prose(n) for n in (1, 2, 3, 40, 200, 3000)] + [prose(30) + "  " + prose(30), prose(20).replace(" ", "\n")]
    return out + [out[-1], out[-3]]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, ("en", "de", None, "es", "é")[i % 5], "s" if i % 2 else None, None if i % 4 == 0 else 10 * i, "t", "r", "p", 1) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "null id", "en", "s", 3, "t", "r", "p", 1), (None, "null id", "en", "s", 3, "t", "r", "p", 1), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def _plain_manifest(rows, fields, fan):
    """Whole trees in lists; rows are dicts."""
    H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*[enc(r[f]) for f in fields])

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            at = i // fan * fan
            yield "".join(level[at:i]), "".join(level[i + 1 : at + fan])
            i //= fan

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = own, tree([leaf(r) for r in own])
    top = tree([trees[name][1][-1][0] for name in names])
    for k, name in enumerate(names):
        own, levels = trees[name]
        for i, r in enumerate(own):
            steps = [*path(levels, i), *path(top, k)]
            tampered = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r | {"n_chars": r["n_chars"] + 1}) if tampered else levels[0][i]
            for a, b in steps:
                node = H(a, node, b)
            yield r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], H(*[x for s in steps for x in s]), node, node == top[-1][0]


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _claims():
    from pyspark.sql import functions as F

    tampered = F.pmod(F.crc32(F.col("row.doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return {"n_chars": F.when(tampered, F.col("row.n_chars") + 1).otherwise(F.col("row.n_chars"))}


@pytest.mark.parametrize(("fan", "band"), [(2, 9), (2, 2), (3, 1), (16, 2)])
def test_manifest(docs, none, fan, band):
    got = [tuple(r) for r in merkle.manifest(docs, FIELDS, claims=_claims(), fan=fan, band=band).collect()]
    want = list(_plain_manifest([r.asDict() for r in docs.collect()], FIELDS, fan))
    same(got, want)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.manifest(none, FIELDS, fan=fan, band=band).count() == 0


def test_manifest_of_one_row_and_of_equal_rows(spark):
    one = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.manifest(one, FIELDS).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == hashlib.sha256(b"").hexdigest()
    many = spark.range(0, 700, 1, 8).selectExpr("cast(7 as bigint) doc_id", "'t' text", "'en' lang", "'s' source", "cast(1 as bigint) n_chars")
    got = [tuple(r) for r in merkle.manifest(many, FIELDS, claims=_claims(), band=3).collect()]
    same(got, list(_plain_manifest([r.asDict() for r in many.collect()], FIELDS, 2)))


def test_manifest_nodes_nest(docs):
    leaves = merkle.leaves_of(docs, FIELDS, "lang", "doc_id")
    nodes = merkle.node_table(leaves, band=2).collect()
    sizes = Counter(r.tree for r in leaves.collect())
    for name, n in sizes.items():
        levels = defaultdict(dict)
        for x in nodes:
            if x.tree == name:
                levels[x.level][x.lo] = x
        assert len(levels) == merkle.levels_of(n, 2) + 1 and len(levels[0]) == n
        for level, own in levels.items():
            assert [x.lo for x in sorted(own.values(), key=lambda x: x.lo)] == list(range(0, n, 2**level))
            for x in own.values():
                assert x.hi == min(x.lo + 2**level, n) - 1
                if level:
                    below = [c for c in levels[level - 1].values() if x.lo <= c.lo and c.hi <= x.hi]
                    assert x.digest == merkle.H(*[c.digest for c in sorted(below, key=lambda c: c.lo)])


def _plain_alignment(rows):
    """Token by token, with the tokenizers of the JSON and the model file."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    a_bytes = lambda i: bytes(byte_of[c] for c in a_of.id_to_token(i))

    def b_bytes(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode()

    out, docs_of = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        groups = []
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if text and b"".join(map(a_bytes, a)) == want == b"".join(map(b_bytes, b)):
            ends, cut = [], ([], [])
            at_a = np.cumsum([len(a_bytes(i)) for i in a]).tolist()
            at_b = np.cumsum([len(b_bytes(i)) for i in b]).tolist()
            ends, i, j = sorted(set(at_a) & set(at_b)), 0, 0
            for end in ends:
                cut = ([], [])
                while i < len(a) and at_a[i] <= end:
                    cut[0].append(a[i])
                    i += 1
                while j < len(b) and at_b[j] <= end:
                    cut[1].append(b[j])
                    j += 1
                groups.append(cut)
        else:
            a = b = []
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        for pair in links:
            docs_of[pair].add(n)
        out.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), held in docs_of.items():
        top[x] = max(top[x], len(held))
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, out, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        counts = [len(docs_of[p]) for p in links]
        best = sum(c == top[p[0]] for c, p in zip(counts, links, strict=True))
        yield doc_id, n_a, n_b, len(groups), len(links), best, sum(counts), hashlib.sha256(text.encode()).hexdigest() if n_a else ""


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK_BYTES, 4000])
def test_alignment(docs, none, chunk_bytes):
    got = [tuple(r) for r in alignment.align_documents(docs, chunk_bytes=chunk_bytes).select(COLUMNS).collect()]
    same(got, list(_plain_alignment([(r.doc_id, r.text) for r in docs.collect()])))
    assert alignment.align_documents(none).count() == 0


def test_alignment_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same([tuple(r) for r in alignment.op13_token_alignment(spark, SF).select(COLUMNS).collect()], list(_plain_alignment(rows)))


def test_groups_cover_the_bytes(docs):
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 20").collect()}
    of = defaultdict(list)
    for r in alignment.token_groups(docs.where("doc_id < 20").dropDuplicates(["doc_id"])).collect():
        of[r.doc_id].append(r)
    counted = {r.doc_id: r.n_groups for r in alignment.align_documents(docs.where("doc_id < 20").dropDuplicates(["doc_id"])).collect()}
    for doc_id, text in texts.items():
        own = sorted(of[doc_id], key=lambda r: r.start)
        assert len(own) == counted[doc_id]
        if own:
            assert own[0].start == 0 and own[-1].stop == len(text.encode()) + 1 and all(x.stop == y.start for x, y in zip(own, own[1:]))


def test_galloping():
    r = np.random.default_rng(5)
    for _ in range(30):
        long, starts, keys, first, last = [], [0], [], [], []
        for _ in range(r.integers(1, 6)):
            own = np.unique(r.integers(0, 500, r.integers(1, 90)))
            first_of = starts[-1]
            long += own.tolist()
            starts.append(len(long))
            own_keys = r.integers(0, own[-1] + 1, r.integers(0, 40))
            keys += own_keys.tolist()
            first += [first_of] * len(own_keys)
            last += [len(long) - 1] * len(own_keys)
        got = alignment.gallop(np.array(keys, int), np.array(first, int), np.array(last, int), np.array(long))
        assert got.tolist() == [f + int(np.searchsorted(long[f : e + 1], k)) for k, f, e in zip(keys, first, last)]


def test_large_groups_are_linked_by_counts(monkeypatch):
    pair = alignment.pair_of(alignment.BYTE_VOCABULARY, alignment.PIECE_MODEL)
    texts = pa.array(["a" * 999 + "日本語" * 50, "aaaa bbb" * 30, "xyz" * 200], pa.large_string())
    whole = alignment._chunk(pair, texts)
    monkeypatch.setattr(alignment, "MANY_LINKS", 1)
    counted = alignment._chunk(pair, texts)
    for k, v in whole.items():
        assert np.array_equal(v, counted[k]), k


def _toy(seed, n):
    r = random.Random(seed)
    words = {"aa": ["the", "and", "thing", "her"], "bb": ["der", "und", "schön", "ßein"], "cc": ["что", "это", "мир"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "", "x"]) for _ in range(r.randrange(4, 90))), lang))
    return rows


def test_gradients_are_those_of_the_loss():
    net = language_id.Network(["a", "b", "c"], units=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    data, label = r.integers(97, 100, (7, 4)), np.array([0, 1, 2, 1])
    weight = (r.random((7, 4)) > 0.3).astype(float)
    _, grads = net.gradients(data, weight, label)
    run = language_id.Network._run

    def loss():
        return net.gradients(data, weight, label)[0]

    assert run(net, data, "f").shape == (7, 4, 3)
    for k, v in net.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 12)]:
            if k[0] == "x" and at[0] not in (97, 98, 99):
                continue
            old = v[at]
            v[at] = old + 1e-2
            up = loss()
            v[at] = old - 1e-2
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-3, (k, at)


def test_both_ways_of_running_agree():
    net = language_id.Network(["a", "b"], seed=2)
    data = language_id.LOWER[np.random.default_rng(1).integers(0, 256, (40, 9))]
    for d in "fb":
        assert np.abs(net._run(data, d) - net._states(data, d)).max() < 1e-5


def test_texts_are_labelled_whole(monkeypatch):
    """A long text's probabilities are the means over all its windows' letters, whatever stands beside it."""
    net = language_id.Network(["a", "b"], seed=2)
    texts = [b"", b"abc 12", b"x" * 700, bytes(range(97, 123)) * 40, b"..."]
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    got = language_id.label_texts(net, np.frombuffer(b"".join(texts), np.uint8), starts)
    for i, t in enumerate(texts):
        total, n = np.zeros(2), 0
        for at in range(0, len(t), language_id.WINDOW):
            cut = np.frombuffer(t[at : at + language_id.WINDOW], np.uint8)
            p = net.probabilities(language_id.LOWER[cut][:, None])[:, :, 0]
            total += (p * language_id.LETTER[cut]).sum(1)
            n += int(language_id.LETTER[cut].sum())
        assert np.abs(got[i] - total / max(n, 1)).max() < 1e-4


def test_language_id(spark):
    rows = _toy(1, 400)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ...", "aa"), (1003, "und schön", None), (None, "the and", "aa"), (1004, "the and " * 20000, "aa"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 5, 1) for r in rows + odd], "doc_id long, text string, lang string, _text int, c0 int").repartition(3)
    net = language_id.fit(df)
    assert net.labels == ["aa", "bb", "cc"]
    got = language_id.identify(df, net).selectExpr("row.doc_id", "row.text", "row.lang", "row._text", "lang_pred", "score").collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r._text == 5 and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert [r.lang_pred for r in got if r.doc_id == 1004] == ["aa"]


def test_language_id_learns_from_its_rows_only(spark):
    rows = spark.createDataFrame(_toy(2, 200), "doc_id long, text string, lang string")
    taken = language_id.sample(rows, per_language=20, most=50)
    assert len(taken) == 50 and max(Counter(x for x, _ in taken).values()) <= 20
    held = rows.where(language_id.held_out_of(rows.doc_id))
    assert language_id.sample(held) == [] and language_id.fit(held) is None
    assert {r.lang_pred for r in language_id.identify(rows, None).collect()} == {"und"}
    empty = rows.limit(0)
    assert language_id.fit(empty) is None and language_id.identify(empty, None).count() == 0


def test_held_out_accuracy_on_the_test_table(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = language_id.op11_language_id(spark, folder).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97
