"""Each operator against brute force on rows with nulls, blanks, ties, repeats, long texts and clashing columns; and on no rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondsight.llm import covertree, decontaminate, minhash, mixing, quality, shared, suffixarray, suffixtree, tokenbin, tokencount, windows
from tests.llm.conftest import rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_decontaminate(spark, docs, none):
    texts = [r[1] for r in rows()]
    items = [(1, texts[9]), (2, "one"), (3, None), (None, " ".join(texts[12].split()[5:9])), (1, "Zzz")]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found.collect())
    wins = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(len(w) - min(10, len(w)) + 1) if w else ():
            wins.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add("" if i is None else str(i))
    want = Counter()
    for r in rows():
        w = ALNUM.findall((r[1] or "").translate(LOW))
        hit, ids = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if tuple(w[k : k + n]) in wins and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        want[(r[0], len(w), len(hit), tuple(sorted(ids)), bool(hit))] += 1
    assert got == want
    held = sum(n for (*_, bad), n in want.items() if bad)
    assert held and decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string")).count() == len(rows()) - held
    assert decontaminate.contaminated(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_decontaminate_extreme_ids_and_clashing_columns(spark):
    data = [(-(1 << 63), "one two three"), (None, "one two three"), (0, "one two"), (5, None)]
    docs = spark.createDataFrame([(*r, *range(9)) for r in data], "doc_id long, text string, k1 int, k2 int, _row int, win int, term int, pos int, n int, start int, _id int")
    items = spark.createDataFrame([(7, "Two THREE")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit, r.contaminated) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(-(1 << 63), 2, True), (None, 2, True), (0, 0, False), (5, 0, False)}
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {0, 5}


def test_second_benchmark_on_a_stored_index(spark, docs):
    """One index of all terms serves two benchmarks; it is read by document without a shuffle."""
    index = decontaminate.postings(docs)
    texts = [r[1] for r in rows()]
    for items in ([(1, texts[9]), (2, "one")], [(3, " ".join(texts[12].split()[50:61])), (4, texts[4]), (5, "no such words")], []):
        some = spark.createDataFrame(items, "item_id long, text string")
        key = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in df.collect())
        assert key(decontaminate.contaminated(docs, some, index=index)) == key(decontaminate.contaminated(docs, some))
    met = index.join(index.select("k1").distinct().hint("shuffle_hash"), "k1", "left_semi")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x x beta"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta"), (8, "")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity(docs, items, 3).collect()} == {1, 2}


def test_near_duplicates(spark, docs, none):
    got = {(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert {(5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False), (None, 5, False), (None, None, True)} <= got
    assert {(i, i, True) for i in (0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 14, 15, 16)} <= got and len(got) == 19
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter([*range(6), *range(9, 17), None])
    assert minhash.near_duplicates(none).count() == 0


def test_many_near_copies_make_one_class(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(x if i != k else "q" for i, x in enumerate(base)) for k in range(80)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = rng.random(400) + 0.1, rng.random(400) + 0.1
    same = []
    for salt in range(40):
        k = minhash.mixed(keys + np.uint64(salt))
        x, y = (minhash.samples(np.zeros(400, int), k, w, 1)[0] for w in (a, b))
        same.append((x == y).mean())
    assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_quality_learns_and_scores_all(spark, none):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["red", "green", "blue", "tree"], 20)) for _ in range(120)]
    bad = [" ".join(rng.choice(["xx!!", "yy!!", "zz$$", "qq%%"], 20)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 3] + [(5, None), (None, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels), F.col("doc_id")).collect()}
    assert all((got[i] >= 0.5) == (i < 120) for i in range(240) if i % 3 == 0) and 0 <= got[900] == got[901] <= 1
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None, F.col("doc_id")).collect()} == {0.5}
    assert quality.score(none, None, F.col("doc_id")).count() == 0


def test_windows(docs, none):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in windows.remove_repeats(docs).collect())
    lists = [(r[0], SPACE.findall(r[1] or "")) for r in rows()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in lists for i in range(len(w) - 34))
    want = Counter()
    for d, w in lists:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[(d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    assert got == want
    one = windows.remove_repeats(docs).where("doc_id = 10").first()
    assert [(s.start, s.end) for s in one.spans] == [(5, 65)] and len(one.kept.split()) == 5
    assert windows.remove_repeats(none).count() == 0


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = shared.shared_dir(spark)
    tokenbin.write_tokens(docs, path, out)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenbin.read_tokens(spark, out).collect())
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = Counter((-1 if r[0] is None else r[0], len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows())
    assert Counter(x[1:] for x in got) == want and [x[1] for x in got] == sorted(x[1] for x in got)
    assert [x[0] for x in got] == list(np.cumsum([0, *(x[2] for x in got)])[:-1])
    out = shared.shared_dir(spark)
    tokenbin.write_tokens(none, path, out)
    assert tokenbin.read_tokens(spark, out).count() == 0


def test_token_boundaries():
    """Pieces are cut as the library cuts them, on odd characters too."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, whole = tokenbin.Tokenizer(path), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = np.random.default_rng(5)
    signs = [*"ab1 \n\t'’.,!sdtrelvmé  　٣中𝒳​\x1c\x85", "'s", "'re", "  "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(800)]
    raw = [t.encode() for t in texts]
    ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_added_tokens_are_one_id(spark):
    """Texts that hold the file's added token, alone, repeated, cut short and over a row's end, as encode() has them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, end = Tokenizer.from_file(path), "<|endoftext|>"
    rng = np.random.default_rng(7)
    signs = [end, end, "<|", "endoftext", "|>", "a", " ", "  ", "\n", "'s", "'", "é", "12", "<"]
    texts = [end, end * 2, f"one {end} two's", f"a  {end}  b", "x <|endof", "text|> y", f"x'{end}s", ""] + ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(400)]
    ids = [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids[0] == [50256, 0]
    raw = [t.encode() for t in texts]
    got, at = tokenbin.Tokenizer(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == ids
    out = shared.shared_dir(spark)
    tokenbin.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, out)
    rows_ = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.read_tokens(spark, out).collect())
    begin = np.cumsum([0, *map(len, ids)]).tolist()
    assert rows_ == [(i, begin[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]


@pytest.mark.parametrize("n", [1, 63, 64, 70_000, 200_001])
def test_token_file_round_trip_and_damage(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint16)
    blob = tokenbin.encode_file(ids, np.array([4]), np.array([True]), np.array([n]))
    back, docs, known, sizes = tokenbin.decode_file(blob)
    assert (back == ids).all() and docs.tolist() == [4] and known.all() and sizes.tolist() == [n]
    if n > 60_000:
        hurt = bytearray(blob)
        hurt[-5] ^= 1
        with pytest.raises(ValueError):
            tokenbin.decode_file(bytes(hurt))


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in rows():
        size[r[3]] += len(SPACE.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held, total = set(), sum(size.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(3 * size[s] for s in held)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] > 3 * size[s]}
        if not more:
            break
        held |= more
    target = {s: 3 * size[s] if s in held else level * weight[s] for s in names}
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows()) and all(taken[s] <= 3 * size[s] for s in names)
    many = spark.createDataFrame([(i, "a b c d " * (i % 9 + 1), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    by = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 40 for r in by)
    assert sorted(mixing.mix(many).collect()) == sorted(mixing.mix(many).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns


def test_suffix_tree(spark, docs, none):
    held = shared.crc_rest(F.col("doc_id"), 7) == 2
    got = suffixtree.score(docs, held).collect()
    taught = [r for r in rows() if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    words = lambda t: [x.encode() for x in SPACE.findall((t or "").translate(LOW))] + [b"\n"]
    c = Counter(w for r in taught for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = {}
    for r in rows():
        want[(r[0], r[1])] = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1])), len(words(r[1])), sum(c[w] > 0 for w in words(r[1]))
    have = sorted((round(r.base_score, 6), r.n_tokens, r.n_known) for r in got)
    assert have == sorted((round(want[(r[0], r[1])][0], 6), *want[(r[0], r[1])][1:]) for r in rows())
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert suffixtree.score(none, held).count() == 0


def test_rare_contexts_stay_in_the_tree(spark, monkeypatch):
    """score() against a plain tree of all contexts with two symbols or more that pass the criterion, however many others there are."""
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice(list("abcdefgh "), 8000)) for _ in range(70)]
    texts = [*noise, "zbc Zbc", "", "zbc", "b bc", None]
    taught = [i % 7 != 2 for i in range(len(texts))]
    assert taught[70] and not taught[72]
    spelled = lambda t: b" " * suffixtree.DEPTH + b"".join(w.encode() + b" " for w in SPACE.findall((t or "").translate(LOW))) + b"\n"
    count = {}
    for raw in (spelled(t) for t, own in zip(texts, taught, strict=True) if own):
        for i in range(suffixtree.DEPTH, len(raw)):
            for n in range(suffixtree.DEPTH + 1):
                count.setdefault(raw[i - n : i], Counter())[raw[i]] += 1
    total = {c: sum(x.values()) for c, x in count.items()}

    def kept(c):
        if total[c] < suffixtree.LEAST:
            return False
        gain = sum(k * np.log(k / total[c] / (count[c[1:]][x] / total[c[1:]])) for x, k in count[c].items())
        return gain > 0.5 * len(count[c]) * np.log(total[c])

    stay = {c for c in count if c and kept(c)}

    def chance(c, x):
        if not c:
            return (count[b""][x] + 1) / (total[b""] + 256)
        up = chance(c[1:], x)
        return (count[c][x] + suffixtree.SMOOTH * up) / (total[c] + suffixtree.SMOOTH) if c in stay else up

    want = [sum(np.log10(chance(raw[i - suffixtree.DEPTH : i], raw[i])) for i in range(suffixtree.DEPTH, len(raw))) for raw in map(spelled, texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffixtree.score(docs, F.col("doc_id") % 7 == 2).collect()}
    assert b"zb" in stay and count[b"zb"] == {ord("c"): 2} and total[b""] > 400_000
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=3e-7, atol=1e-4)  # whole logarithms
    for batch, hot in ((3000, 1e9), (40_000, 0.2), (3000, 4)):  # many batches and buckets, endings in parts or not: the same
        monkeypatch.setattr(suffixtree, "BATCH", batch)
        monkeypatch.setattr(suffixtree, "HOT", hot)
        got = {r.doc_id: r.score for r in suffixtree.score(docs, F.col("doc_id") % 7 == 2).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=3e-7, atol=1e-4)


def test_hot_endings_are_dealt_out_in_parts():
    grams, count = np.array([1, 2, 3, 4], np.uint64), np.array([1000, 10, 10, 5])
    deal = suffixtree.Dealing(16, grams, count)
    assert deal.hot.tolist() == [1] and deal.parts.tolist() == [8]
    wire = suffixtree._unwired(np.arange(256, dtype=np.uint64) << np.uint64(32) | np.uint64(1 << 8 | 99))  # the byte before the ending varies
    assert len(set((deal.hashes(wire) % np.uint64(16)).tolist())) > 3
    told = {b: (k.tolist(), n.tolist()) for b, k, n in deal.wholes(wire, np.ones(256, np.int64))}
    assert set(told) >= set((deal.hashes(wire) % np.uint64(16)).tolist()) and all(x == ([1 << 8 | 99], [256]) for x in told.values())


def test_token_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    least = min(s for _, s in vocabulary)
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary, *((f"<0x{b:02X}>", least) for b in range(256))], unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    got = Counter((r.doc_id, r.n_pieces) for r in tokencount.count_tokens(docs, vocabulary).collect())
    assert got == Counter((r[0], sum(len(whole.encode(w, add_special_tokens=False).ids) for w in SPACE.findall(r[1] or ""))) for r in rows())
    assert tokencount.count_tokens(none, vocabulary).count() == 0
    ties = tokencount.count_tokens(docs.limit(0).sparkSession.createDataFrame([(1, "aaaa")], "doc_id long, text string"), [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)]).first()
    assert ties.n_pieces == 3 and ties.score == -5.0  # the earliest start stays among equals


def linked(x, cosine=0.95):
    """Brute force: links and smallest reachable row of each row."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root[None], len(x)).min(1))
        if (new == root).all():
            return link, root
        root = new


def some_vectors(rng, n=300):
    x = rng.normal(size=(n, 16))
    x[100:160] = x[:60] + rng.normal(size=(60, 16)) * 0.12
    x[160:200] = x[0] + rng.normal(size=(40, 16)) * 0.15
    x[200:220] = x[5]
    x[220:n] = x[7] + rng.normal(size=(n - 220, 16)) * 0.6  # loose: many distances near the threshold
    return x


@pytest.mark.parametrize("groups", [1, 512])
def test_cover_tree(spark, monkeypatch, groups):
    x = some_vectors(np.random.default_rng(2))
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [1.0, 2.0], 1), (305, [1.0, 2.0], 1), (None, x[5].tolist(), 1), (306, [], None)]
    data += [(307, [1e200, 1e200], 1), (308, [3.0, 3.0], 1), (309, [1e-200, 2e-200], 1), (310, [5e-324, 1e-323], 1), (311, [-0.0, -3.0], 1), (312, [0.0, -4.0], 1)]
    monkeypatch.setattr(covertree, "BLOCK", 20)  # so that there are several sides
    monkeypatch.setattr(covertree, "GROUPS", groups)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, node int")).collect()}
    link, root = linked(x)
    assert all(got[i] == (link[i].sum(), root[i], root[i] == i) for i in range(300)) and 0 < link[220:].sum() < 80 * 79
    assert all(got[i] == (0, i, True) for i in (300, 301, 302, 303, 306)) and got[None] == (0, None, True)
    assert [got[i][:2] for i in (304, 305, 309, 310)] == [(3, 304)] * 4  # one direction, whatever the length
    assert [got[i] for i in (307, 308)] == [(1, 307, True), (1, 307, False)] and [got[i][:2] for i in (311, 312)] == [(1, 311)] * 2
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_levels_and_dual_descent():
    """Nesting, covering, separation, measured radii; and that the descent loses no pair and rules some out."""
    x = some_vectors(np.random.default_rng(3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.Tree.build(x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    under = tree.parents[-1]
    for level in range(len(tree.centres) - 1, -1, -1):
        c, r = tree.centres[level], tree.radii[level]
        assert all(abs(d[c[k], under == k].max() - r[k]) < 1e-6 for k in range(len(c)))
        if level:
            size = covertree.TOP / 2**level
            assert r.max() <= size and set(tree.centres[level - 1]) <= set(c)
            for k in range(len(tree.centres[level - 1])):
                own = c[tree.parents[level] == k]
                assert own[0] == tree.centres[level - 1][k] and (d[np.ix_(own, own)] + 9 * np.eye(len(own)) > size).all()
            under = tree.parents[level][under]
    reach = covertree.apart(0.95)
    active = covertree.meeting(tree, tree, x, x, reach)
    leaf = tree.parents[-1]
    assert active[leaf][:, leaf][x @ x.T >= 0.95].all() and active.mean() < 0.5


def test_suffix_array(docs, none):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixarray.remove_repeats(docs).collect())
    raw = [(r[0], (r[1] or "").encode()) for r in rows()]
    first = {}
    for d, b in raw:
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = Counter()
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert suffixarray.remove_repeats(none).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_classes_equal_brute_force(spark, monkeypatch, rounds):
    """Chains of variants, some pairs below the threshold: the components are those of all pairs. rounds=0: by blocks alone."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 150)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(150, k % 5 + 1, replace=False):
            own[at] = f"e{k}x{at}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "FLOOR", 100)  # all shingles weigh 1
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == root
