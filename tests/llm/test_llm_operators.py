"""The training-data operators against brute force on small hand-made tables, with nulls, ties, copies, empty tables and clashing columns."""

import math
import random
import unicodedata

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, clusters, leak, neighbours, quality, setcodes, together, topn, trees, words


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def baskets(seed=0, users=300, hot_copies=60):
    """Sets with a few items in nearly all, near-copies, exact copies of one set, nulls, empties and long ones."""
    rng = random.Random(seed)
    out = {}
    for u in range(users):
        s = {i for i in range(4) if rng.random() < 0.7} | {rng.randrange(4, 60) for _ in range(rng.randrange(0, 9))}
        if u % 5 == 1 and out:
            s = set(out[rng.choice(sorted(out))])
            s ^= {rng.randrange(60)}
        out[u] = s
    for u in range(users, users + hot_copies):
        out[u] = {1, 2, 3, 50, 51, 52}
    out[users + hot_copies] = set(range(60))
    rows = []
    for u, s in out.items():
        items = [i for i in s for _ in range(rng.randrange(1, 3))] + [None] * rng.randrange(2)
        rng.shuffle(items)
        rows.append((u, items, "x"))
        if u % 40 == 0:
            rows.append((u, items[::-1], None))
    rows += [(10**6, None, "y"), (10**6 + 1, [], "y"), (None, [1, 2], "y")]
    return {u: s for u, s in out.items() if s}, rows


SETS = "user_id bigint, train_items array<bigint>, source string"


def clashing(df):
    """Extra columns with the operators' inner names."""
    for c in ("s", "cid", "k1", "f", "n", "c", "r", "item", "item_a", "v", "g", "i", "m", "key", "x", "h", "toks"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


@pytest.mark.parametrize("heavy", [1 / 64, 0.3, 2.0])
def test_pairs(spark, heavy):
    sets, rows = baskets()
    n = len(sets)
    f, c = {}, {}
    for s in sets.values():
        for a in s:
            f[a] = f.get(a, 0) + 1
            for b in s:
                if a < b:
                    c[a, b] = c.get((a, b), 0) + 1
    df = clashing(frame(spark, rows, SETS))
    expected = sorted((a, b, x) for (a, b), x in c.items() if x >= 8)
    assert rows_of(together.item_pairs(df, "user_id", "train_items", 8, heavy=heavy).select("item_a", "item_b", "c")) == expected
    high = sorted((a, b) for (a, b), x in c.items() if x >= 3 and x * n >= 1.5 * f[a] * f[b])
    assert rows_of(together.item_pairs(df, "user_id", "train_items", 3, 1.5, heavy=heavy).select("item_a", "item_b")) == high
    assert together.item_pairs(df.filter("false"), "user_id", "train_items").count() == 0


def test_pairs_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(together, "CODES", 50)
    sets, _ = baskets(3, 80, 10)
    flat = np.concatenate([np.array(sorted(s)) for s in sets.values()])
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets.values()])])
    c = {}
    for b in together.count_block(np.array([1, 2, 50]), flat, starts):
        for x, y, k in zip(*(col.to_pylist() for col in b.columns)):
            c[x, y] = c.get((x, y), 0) + k
    expected = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    expected[a, b] = expected.get((a, b), 0) + 1
    assert c == expected


@pytest.mark.parametrize("bands", [(0.05, 0.25), (0.5,), (0.001, 0.01, 0.9), ()])
def test_top_n(spark, bands):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(200), float(rng.randrange(12))) for _ in range(1500)]
    rows += [(7, 8, -1.0), (7, 9, float("inf")), (8, 1, float("nan")), (8, 2, None), (None, 1, 1.0), (1, None, 9.0), (9, 9, 5.0), (9, 1, float("-inf"))]
    best = {}
    for g, i, v in rows:
        if g is not None and i is not None and v is not None and not math.isnan(v) and g != i:
            best[g, i] = max(v, best.get((g, i), -math.inf))
    expected = []
    for g in {g for g, _ in best}:
        top = sorted((-v, i) for (h, i), v in best.items() if h == g)[:10]
        expected += [(g, i, -v, k + 1) for k, (v, i) in enumerate(top)]
    df = clashing(frame(spark, rows, "cooc_rows bigint, cooc_cols bigint, cooc_vals float"))
    assert rows_of(topn.top_n(df, "cooc_rows", "cooc_cols", "cooc_vals", 10, bands)) == sorted(expected)
    assert topn.top_n(df.filter("false"), "cooc_rows", "cooc_cols", "cooc_vals").count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_users(spark):
    sets, rows = baskets(5)
    kept = {u: s for u, s in sets.items() if len(s) >= 5}
    links = {(a, b) for a in kept for b in kept if a < b and 10 * len(kept[a] & kept[b]) >= 7 * len(kept[a] | kept[b])}
    df = clashing(frame(spark, rows, SETS))
    assert rows_of(setcodes.similar_users(df)) == sorted(links)
    n = {u: sum(u in p for p in links) for u in kept}
    assert {r.user_id: r.n_links for r in setcodes.user_links(df).collect()} == n
    assert setcodes.similar_users(df.filter("false")).count() == 0


@pytest.mark.parametrize("length", [0, 4, 12])
def test_segments_of_any_length_lose_nothing(spark, length):
    sets, _ = baskets(6, 150, 0)
    kept = {u: s for u, s in sets.items() if len(s) >= 5}
    distinct = {}
    for u, s in kept.items():
        distinct.setdefault(frozenset(s), u)
    classes = frame(spark, [(u, sorted(s)) for s, u in distinct.items()], "cid bigint, s array<bigint>")
    got = {(r.a, r.b) for r in setcodes.similar_classes(classes, None, 7, 10, "minhash", 0.15, length).collect()}
    assert got == {(min(a, b), max(a, b)) for x, a in distinct.items() for y, b in distinct.items() if a < b and jaccard(x, y) >= 0.7}


def test_overlap_across_splits(spark):
    sets, rows = baskets(7, 120, 5)
    rng = random.Random(8)
    val = [(i, [*rng.sample(sorted(sets[u]), len(sets[u])), *([rng.randrange(60)] if i % 2 else [])], "p") for i, u in enumerate(rng.sample(sorted(sets), 40))]
    val += [(900, None, "p"), (901, [], None), (None, [1, 2, 3, 4, 5], "q"), (val[0][0], val[0][1][::-1], None)]
    test = [(1000 + i, list(sets[u]), None) for i, u in enumerate(sorted(sets)[:20])]
    ev = {("val", e): set(s) for e, s, _ in val if e is not None and s and len(set(s)) >= 5} | {("test", e): set(s) for e, s, _ in test if len(set(s)) >= 5}
    expected = sorted((sp, e, u) for (sp, e), s in ev.items() for u, t in sets.items() if len(t) >= 5 and 4 * len(s & t) >= 3 * len(s | t))
    frames = frame(spark, rows, SETS), frame(spark, val, "eval_id bigint, val_set array<bigint>, source string"), frame(spark, test, "eval_id bigint, test_set array<bigint>, source string")
    frames = [clashing(x) for x in frames]
    assert rows_of(setcodes.split_overlap(*frames)) == expected
    report = {(r.split_name, r.source): (r.n_records, r.n_overlapping) for r in setcodes.split_overlap_report(*frames).collect()}
    assert sum(n for n, _ in report.values()) == len(ev) and sum(h for _, h in report.values()) == len({x[:2] for x in expected})
    assert setcodes.split_overlap(frames[0], frames[1].filter("false"), frames[2].filter("false")).count() == 0


def test_radii_lose_less_than_they_say():
    rng = np.random.default_rng(3)
    for bits, p, num, den in ((setcodes.minhash_bits, setcodes.minhash_difference(7, 10), 7, 10), (setcodes.similarity_bits, setcodes.simhash_difference(3, 4, 5), 3, 4)):
        worst = 0
        for _ in range(2000):
            size = int(rng.integers(5, 40))
            x = rng.choice(10**6, 2 * size, replace=False)
            most = int(np.floor((1 - num / den) * size))
            drop = int(rng.integers(0, most + 1))
            a, b = np.sort(x[:size]), np.sort(x[: size - drop])
            if len(b) < 5:
                continue
            code = bits(np.concatenate([a, b]), np.array([0, len(a)]))
            worst = max(worst, int((code[0] != code[1]).sum()))
        assert worst <= setcodes.radius(p)
    # beyond the sizes that the difference is computed for it tends to the angle's share
    worst, large = setcodes.simhash_difference(3, 4, 5), setcodes.simhash_difference(3, 4, 300, 300)
    assert math.acos(6 / 7) / math.pi < large < worst
    assert setcodes.radius(0.5) < 256 and setcodes.radius(0.01) < setcodes.radius(0.2)


ITEMS = "item_id bigint, image_feat array<float>, text_feat array<float>, meta_category bigint"


def item_rows(n_clusters=40, seed=0, copies=9):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c in range(n_clusters):
        ci, ct = rng.standard_normal(96), rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 14))):
            scale = float(rng.uniform(0.1, 30))
            a = scale * (ci + 0.25 * rng.standard_normal(96))
            rows.append([k, a.tolist(), (ct + 0.25 * rng.standard_normal(64)).tolist(), c])
            k += 1
    for j in range(copies):
        rows.append([k + j, rows[3][1], rows[3][2], None])
    k += copies
    rows.append(list(rows[5]))
    bad = rows[0][1]
    rows += [[k, None, rows[1][2], 0], [k + 1, [0.0] * 96, None, 0], [k + 2, [float("nan"), *bad[1:]], [1.0] * 40, 0], [k + 3, [None, *bad[1:]], [float("inf")] * 64, 0], [None, bad, rows[0][2], 0]]
    return [tuple(r) for r in rows]


def valid(rows, column, dim):
    out = {}
    for r in rows:
        v = r[column]
        if r[0] is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            out[r[0]] = x / np.linalg.norm(x)
    return out


def test_neighbours(spark):
    rows = item_rows()
    expected = set()
    for name, col, dim in (("image", 1, 96), ("text", 2, 64)):
        x = valid(rows, col, dim)
        ids = sorted(x)
        for i in ids:
            sims = sorted((-round(float(x[i] @ x[j]), 9), j) for j in ids if j != i)[:5]
            expected |= {(name, min(i, j), max(i, j)) for s, j in sims if -s >= 0.8}
    df = clashing(frame(spark, rows, ITEMS))
    assert set(rows_of(neighbours.similar_pairs(df))) == expected
    assert neighbours.similar_pairs(df.filter("false")).count() == 0


def test_forest_recall(spark, monkeypatch):
    """Blocks far smaller than the table and few candidates, so that the forest has to find neighbours by prefixes."""
    monkeypatch.setattr(neighbours, "BLOCK", 400)
    monkeypatch.setattr(neighbours, "GATHER", 256)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((400, 64))
    x = (np.repeat(centre, 8, 0) + 0.42 * rng.standard_normal((3200, 64))).astype(np.float32)
    df = frame(spark, [(i, None, v.tolist(), None) for i, v in enumerate(x)], ITEMS)
    found = {(r.item_id, r.neighbour) for r in neighbours.most_similar(df).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -1)
    top = np.argsort(-s, axis=1)[:, :5]
    true = {(i, int(j)) for i in range(3200) for j in top[i] if s[i, j] >= 0.8}
    assert len(true & found) / len(true) >= 0.95


def test_ascent_takes_the_deepest_level_with_enough():
    rng = np.random.default_rng(2)
    strings = rng.integers(0, 1 << 63, (50, 3), dtype=np.int64).view(np.uint64) << np.uint64(1)
    strings[:5] = strings[5:10]
    bits = [[format(int(v), "064b") for v in row] for row in strings]
    for gather in (1, 4, 20, 150, 151):
        got = neighbours.Arrays(strings).ascended(gather)
        for i in range(50):
            counts = [sum(b[a][:v] == bits[i][a][:v] for b in bits for a in range(3)) for v in range(65)]
            assert got[i] == max([v for v in range(65) if counts[v] >= gather], default=0)


def components(x, least=0.8):
    ids = sorted(x)
    near = {i: {j for j in ids if x[i] @ x[j] >= least} | {i} for i in ids}
    return {(min(g), i) for i, g in near.items() if len(g) > 1 and all(near[j] == g for j in g)}


@pytest.mark.parametrize("part", [6000, 25])
def test_clusters(spark, monkeypatch, part):
    monkeypatch.setattr(clusters, "CELL", part)
    monkeypatch.setattr(clusters, "CELL_MEAN", 5 * part)
    rows = item_rows(60, 5, copies=40)
    expected = {(name, c, i) for name, col, dim in (("image", 1, 96), ("text", 2, 64)) for c, i in components(valid(rows, col, dim))}
    df = clashing(frame(spark, rows, ITEMS))
    assert set(rows_of(clusters.found_clusters(df))) == expected
    if part == 6000:
        described = clusters.described_clusters(df).collect()
        sizes = {}
        for m, c, _ in expected:
            sizes[m, c] = sizes.get((m, c), 0) + 1
        assert {(r.modality, r.cluster_id): r["size"] for r in described} == sizes
        assert clusters.found_clusters(df.filter("false")).count() == 0


@pytest.mark.parametrize("part", [6000, 25, 1])
def test_chains_and_near_misses_are_no_clusters(spark, monkeypatch, part):
    """Chains of three, pairs just under the least cosine, and clusters with one outsider near one member; the pieces don't matter."""
    monkeypatch.setattr(clusters, "CELL", part)
    rng = np.random.default_rng(12)

    def turned(a, cos):
        b = rng.standard_normal(len(a))
        b -= (a @ b) * a
        return cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b)

    x = []
    for c in range(8):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        near = turned(a, 0.825)
        x += [a, near, turned(near, 0.825)] if c % 4 == 0 else []
        x += [a, turned(a, 0.79)] if c % 4 == 1 else []
        x += [a, *(turned(a, 0.95) for _ in range(4))] if c % 4 == 2 else []
        x += [a, *(turned(a, 0.96) for _ in range(3)), turned(a, 0.81)] if c % 4 == 3 else []
    ids = rng.permutation(500)[: len(x)].tolist()
    expected = {("text", c, i) for c, i in components({i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in zip(ids, x)})}
    df = frame(spark, [(i, None, v.tolist(), None) for i, v in zip(ids, x)], ITEMS)
    assert set(rows_of(clusters.found_clusters(df))) == expected and expected


@pytest.fixture(scope="module")
def tiktoken_50k():
    e = bpe.encoder_of(bpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(e.tokens)}, special_tokens={})


def test_encoding(spark, data, tiktoken_50k):
    rng = random.Random(1)
    bits = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "lll", "B", "9", "½", "é", "!", "’", "ſ", " '", " ", "日本", "🔒", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(15))) for _ in range(3000)]
    texts += ["", None, " ", "\n", "l" * 5000, "ab" * 3000, "\u0000", "x" * 100_000]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    df = clashing(frame(spark, list(enumerate(texts)), "doc_id bigint, text string")).withColumn("ids", F.lit(1))
    encoded = bpe.encode_documents(df)
    have = {r.doc_id: r.ids for r in encoded.collect()}
    assert have == {i: tiktoken_50k.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_documents(df.filter("false")).count() == 0


def test_encoding_of_any_bytes(tiktoken_50k):
    e = bpe.encoder_of(bpe.default_vocabulary())
    rng = random.Random(2)
    for _ in range(4000):
        piece = bytes(rng.choice(b"aabclthe ing10\xe2\x96\x88\n=-l\xff") for _ in range(rng.randrange(1, 30)))
        assert e.encode_piece(piece) == tiktoken_50k._encode_single_piece(piece)


def split_words(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def leak_tables(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)), "a") for i, n in enumerate([20, 25, 60, 19, 5, 0, 40])]
    passages += [(7, None, "b"), (None, passages[0][1], "b"), (8, passages[1][1].upper(), "b")]
    docs = []
    for d in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        if d % 4 == 0:
            p = passages[rng.randrange(7)][1].split()
            a = rng.randrange(len(p) + 1)
            at = rng.randrange(len(body) + 1)
            body[at:at] = p[a : a + rng.randrange(15, 45)]
        docs.append((d, rng.choice([" ", "\n", ", ", " — "]).join(body)))
    docs += [(100, None), (101, ""), (102, "  \n"), (103, (passages[2][1] + ". ") * 400), (None, passages[2][1])]
    return docs, passages


def test_leaks(spark):
    docs, passages = leak_tables(spark)
    grams = {p: {tuple(w[i : i + 20]) for w in [split_words(t or "")] for i in range(len(w) - 19)} for p, t, _ in passages if p is not None}
    expected = []
    for d, t in docs:
        w = split_words(t or "")
        mine = {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
        expected += [(d, p) for p, g in grams.items() if d is not None and g & mine]
    df = clashing(frame(spark, docs, "doc_id bigint, text string"))
    ps = frame(spark, passages, "passage_id bigint, passage string, suite string")
    assert rows_of(leak.leaked_passages(df, ps)) == sorted(expected) and expected
    assert leak.leak_report(df, ps).count() == len({p for _, p in expected})
    assert leak.leaked_passages(df.filter("false"), ps).count() == 0
    assert leak.leaked_passages(df, ps.filter("false")).count() == 0


def test_leaks_in_several_blocks(spark, monkeypatch):
    docs, passages = leak_tables(spark)
    df, ps = frame(spark, docs, "doc_id bigint, text string"), frame(spark, passages, "passage_id bigint, passage string, suite string")
    whole = rows_of(leak.leaked_passages(df, ps))
    monkeypatch.setattr(leak, "INDEX_WINDOWS", 50)
    assert rows_of(leak.leaked_passages(df, ps)) == whole


def words_apart(a, b):
    """Edit distance of two lists of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_leaks_with_edits(spark, edits):
    """Recall over substitutions, insertions and deletions in one window, no false rows, against brute force on the edited runs."""
    rng = random.Random(9)
    passages = [[f"p{i}x{k}" for i in range(30)] for k in range(6)]
    docs, within = [], set()
    for d in range(300):
        k, w = d % 6, passages[d % 6][5:25]
        for _ in range(edits + (d % 10 == 9)):
            at, kind = rng.randrange(1, len(w) - 1), rng.randrange(3)
            w[at : at + (kind != 1)] = [f"z{d}y{rng.randrange(10**9)}"] if kind < 2 else []
        docs.append((d, " ".join([f"a{d}"] * 5 + w + [f"b{d}"] * 5)))
        ends = range(len(w) - 2 * edits, len(w) + 2)
        if any(words_apart(passages[k][s : s + 20], (w + ["b"])[a:e]) <= edits for s in range(3, 8) for a in range(3) for e in ends):
            within.add((d, k))
    df = frame(spark, docs, "doc_id bigint, text string")
    ps = frame(spark, [(k, " ".join(p), "s") for k, p in enumerate(passages)], "passage_id bigint, passage string, suite string")
    found = {tuple(r) for r in leak.leaked_passages(df, ps, 20, edits).collect()}
    assert found <= within and len(found) >= 0.95 * len(within) > 200
    assert {tuple(r) for r in leak.leaked_passages(df, ps, 20, 0).collect()} <= within


def test_edit_distances():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 400).astype(np.uint64)
    passage = rng.integers(1, 6, 60).astype(np.uint64)
    x, y = rng.integers(0, 395, 200), rng.integers(0, 52, 200)
    ends = np.minimum(x + rng.integers(1, 14, 200), 400)
    for most in (1, 2, 3):
        got = leak.edit_distances(text, x, ends, passage, y, 8, most)
        for g, i, e, j in zip(got, x, ends, y):
            assert g == min(most + 1, min(words_apart(passage[j : j + 8].tolist(), text[i : i + n].tolist()) for n in range(e - i + 1)))


def brute_statistics(t, common):
    w = split_words(t)
    lines = [x.strip(" \t\r") for x in t.split("\n")]
    lines = [x for x in lines if x]
    symbols = sum(unicodedata.category(c)[0] not in "LN" and not c.isspace() for c in t)
    div = lambda a, b: a / b if b else None
    return (len(w), div(sum(map(len, w)), len(w)), div(symbols, len(t)), len(lines), div(sum(x[-1] in ".!?;:" for x in lines), len(lines)), div(sum(x in common for x in w), len(w)))


def test_statistics(spark, data):
    texts = ["", None, " ", "\n\n", "a", "A.\r\nb\t\n\n c! \n", "İstanbul ΑΣ. ΑΣ", "▇▇▇ [x]", "x" * 50_000, "word. " * 20_000, "²½ ①", "a b\u0085c", "end\n", "the\nof."]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    common = ["the", "of", "und", None, "le"]
    df = clashing(frame(spark, list(enumerate(texts)), "doc_id bigint, text string"))
    stats = quality.document_statistics(df, frame(spark, [(w,) for w in common], "word string"))
    assert {r.doc_id: tuple(r)[1:] for r in stats.collect()} == {i: brute_statistics(t or "", {w for w in common if w}) for i, t in enumerate(texts)}
    assert quality.junk_documents(df.filter("false"), frame(spark, [], "word string")).count() == 0


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    x[::50, 1] = np.nan
    y = ((x[:, 0] > 0.3) ^ (np.nan_to_num(x[:, 1], nan=-9) > 0)).astype(float)
    m = trees.Boosted(trees=30).fit(x[:2000], y[:2000])
    assert (((m.score(x[2000:]) > 0) == y[2000:]).mean()) > 0.95
    a, b = trees.platt(m.score(x[2000:]), y[2000:])
    assert a > 0
    assert trees.platt(np.zeros(3), np.ones(3)) == (1.0, 0.0)


def test_trees_on_other_documents(spark, data):
    """Held-out: trained on half of the documents, recall of candidates and agreement with the weak labels on the other half, calibration on the judged ones."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    common = quality._common_hashes(spark.read.parquet(f"{data}/common_words.parquet"))
    rows = quality.weakly_labelled(docs, common).toPandas()
    stats, labels = rows[quality.STATS].to_numpy(float), rows["junk"].to_numpy(bool)
    model = quality.Model(stats[::2], labels[::2])
    p, junk = model.probability(stats[1::2]), quality.votes(stats[1::2]) >= 2
    assert (p[junk] >= quality.CANDIDATE).all()
    assert ((p >= 0.5) == labels[1::2]).mean() > 0.95
    held, judged = quality.held_statistics(), quality.held_judgements()
    assert ((model.probability(held) >= 0.5) == judged).mean() > 0.95
    assert ((model.probability(held) - judged) ** 2).mean() < 0.05


def test_structure_of_texts():
    prose = "The court finds that the claim of the vessel was late. It was not revived by the statute. The appeal is dismissed with costs.\n" * 3
    assert quality.structure(prose) < 0
    assert quality.structure("\n".join(f"{i} | the item | {i * 37}.20 | |" for i in range(20))) > 0
    assert quality.structure("\n".join(f"- part {i}" for i in range(20))) > 0
    assert quality.structure("") == quality.structure(" \n") == 0


def test_words_of_portions():
    texts = ["ab", None, "c" * 10, "", "d"]
    assert list(words.portions(texts, 5)) == [(0, ["ab", ""]), (2, ["c" * 10]), (3, ["", "d"])]
    h, first = words.word_hashes(["Ab c", "", "c ab."])
    assert h[0] == h[3] and h[1] == h[2] and first.tolist() == [0, 2, 2, 4]


def test_sets_that_share_one_item(spark):
    """Jaccard similarity 1/2 with a single common item, which is in all sets."""
    classes = frame(spark, [(0, [7]), (1, [7, 8]), (2, [7, 9]), (3, [7, 10])], "cid bigint, s array<bigint>")
    assert {(r.a, r.b) for r in setcodes.similar_classes(classes, None, 1, 2, "minhash", setcodes.minhash_difference(1, 2)).collect()} == {(0, 1), (0, 2), (0, 3)}
