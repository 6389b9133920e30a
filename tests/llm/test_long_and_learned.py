"""Texts above the 2 MB that a task takes at a time, for every operator; and what the classifier learns, step by step."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondsight.llm import decontaminate, linededup, minhash, mixing, periods, quality, spelling, suffixarray, suffixtree, tokenbin, tokencount, windows
from bondsight.llm.shared import BATCH_BYTES

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = 340_000
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = [rng.choice(vocabulary) for _ in range(WORDS)]
    near = list(long)
    near[1000] = "CHANGED"
    return {1: " ".join(long), 2: " ".join(long[-80:]), 3: " ".join(near), 4: "short and plain", 5: None}


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    assert len(texts[1].encode()) > BATCH_BYTES
    return spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_decontaminate(spark, long_docs, texts):
    items = spark.createDataFrame([(7, " ".join(texts[1].split(" ")[-30:-10]))], "item_id long, text string")
    got = by_id(decontaminate.contaminated(long_docs, items))
    assert [got[i].n_hit for i in range(1, 6)] == [20, 20, 20, 0, 0] and got[1].n_words == WORDS


def test_long_minhash(long_docs):
    got = by_id(minhash.near_duplicates(long_docs))
    assert got[1].class_id == got[3].class_id == 1 and len({got[i].class_id for i in (1, 2, 4, 5)}) == 4


def test_long_quality(spark, long_docs):
    model = quality.train(long_docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, label int"))
    got = by_id(quality.score(long_docs, model, F.col("doc_id")))
    assert got[1].score > got[4].score and all(0 <= r.score <= 1 for r in got.values())
    parts = quality.score(spark.createDataFrame([(9, "a " * 2_000_000)], "doc_id long, text string"), None, F.col("doc_id")).first()
    assert parts.score == 0.5


def test_long_windows(long_docs, texts):
    got = by_id(windows.remove_repeats(long_docs))
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed) == (WORDS, WORDS - 1, 80) and (got[1].kept, got[3].kept) == (texts[1].split(" ")[1000], "CHANGED")


def test_long_token_files(spark, long_docs, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenbin.write_tokens(long_docs, path, str(tmp_path / "out"))
    got = by_id(tokenbin.read_tokens(spark, str(tmp_path / "out")))
    whole = Tokenizer.from_file(path)
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_long_mixing(long_docs):
    got = by_id(mixing.mix(long_docs))
    assert [got[i].size for i in range(1, 6)] == [WORDS, 80, WORDS, 3, 0]


def test_long_suffix_tree(long_docs):
    got = by_id(suffixtree.score(long_docs, F.col("doc_id") == 3))
    assert got[1].n_tokens == WORDS + 1 and got[3].n_known == WORDS and got[3].score == pytest.approx(got[1].score, rel=1e-3) and got[3].held_out


def test_long_token_counts(long_docs, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    least = min(s for _, s in vocabulary)
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary, *((f"<0x{b:02X}>", least) for b in range(256))], unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    size = lambda t: sum(n * len(whole.encode(w, add_special_tokens=False).ids) for w, n in Counter(SPACE.findall(t or "")).items())
    assert {i: r.n_pieces for i, r in by_id(tokencount.count_tokens(long_docs, vocabulary)).items()} == {i: size(t) for i, t in texts.items()}


def test_long_suffix_array(long_docs, texts):
    got = by_id(suffixarray.remove_repeats(long_docs))
    tail = texts[2].encode()
    assert got[1].n_removed == 0 and got[2].n_removed == len(tail) and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].kept == b"CHANGED"


def test_long_lines_runs_and_words(spark, long_docs, texts):
    lined = spark.createDataFrame([(i, t and re.sub(r"((?:\S+ ){20})", r"\1\n", t)) for i, t in texts.items()], "doc_id long, text string")
    each = {r.doc_id: [x.strip().lower() for x in (r.text or "").split("\n")] for r in lined.collect()}
    seen = Counter(x for own in each.values() for x in set(own))
    got = by_id(linededup.drop_lines(lined, 2))
    assert {i: (r.n_lines, r.n_dropped) for i, r in got.items()} == {i: (len(own), sum(x != "" and seen[x] >= 2 for x in own)) for i, own in each.items()} and got[1].n_dropped > 16_000
    assert by_id(periods.find_runs(long_docs))[1].n_words == WORDS
    words = {r.word: r.n for r in spelling.vocabulary(spelling.occurrences(long_docs)).collect()}
    counts = Counter(x for t in texts.values() for x in re.findall(r"[A-Za-zÀ-ÿ]+", (t or "").replace("CHANGED", "changed")))
    assert words == {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_two_gradient_steps_by_hand(monkeypatch):
    """Two steps over one batch, a number at a time: softmax of the mean vector, and every share of the error."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "BATCH", 8)
    rows = [(1, [3, 5], [0.25, 0.75]), (0, [5, 9, 11], [0.5, 0.25, 0.25]), (1, [3], [1.0]), (0, [], [])]
    vectors = np.random.default_rng(1).normal(0, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    rate = (2 + 0.5) / 5
    weights, bias = np.zeros((quality.DIM, 2)), [np.log(1 - rate), np.log(rate)]
    for step in range(2):
        now, new_w, new_b, new_v = quality.RATE * (1 - step / 2), weights.copy(), list(bias), vectors.copy()
        for label, buckets, shares in rows:
            mean = [sum(s * vectors[b][d] for b, s in zip(buckets, shares, strict=True)) for d in range(quality.DIM)]
            z = [sum(mean[d] * weights[d][k] for d in range(quality.DIM)) + bias[k] for k in range(2)]
            p = [np.exp(x) / sum(np.exp(y) for y in z) for x in z]
            error = [p[k] - (label == k) for k in range(2)]
            for k in range(2):
                new_b[k] -= 0.05 * now * error[k] / len(rows)
                for d in range(quality.DIM):
                    new_w[d][k] -= now * mean[d] * error[k] / len(rows)
            for b, s in zip(buckets, shares, strict=True):
                for d in range(quality.DIM):
                    new_v[b][d] -= now * 20 * s * sum(error[k] * weights[d][k] for k in range(2))
        weights, bias, vectors = new_w, new_b, new_v
    got = quality.fit([(y, np.array(b, np.int32), np.array(s, np.float32)) for y, b, s in rows])
    assert np.allclose(got[:-1][[3, 5, 9, 11, 77]], (vectors @ (weights[:, 1] - weights[:, 0]))[[3, 5, 9, 11, 77]], atol=1e-5) and abs(got[-1] - (bias[1] - bias[0])) < 1e-5


def test_held_out_accuracy(spark):
    """The registered query's own fold of the given labels: learned on two thirds, right on most of the rest."""
    from bondsight.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = queries.op3_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "predicted").collect()
    assert len(rows) > 50 and np.mean([r.quality == r.predicted for r in rows]) > 0.9


@pytest.mark.parametrize("rounds", [0, 2])
def test_weighted_classes_equal_brute_force(spark, monkeypatch, rounds):
    """Classes by weighted Jaccard over all pairs, with frequent shingles weighing less; without the weights they differ."""
    rng = random.Random(13)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for _ in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for k in range(3):
            told = list(own)
            for at in rng.sample(range(90), k and rng.randint(1, 2)):
                told[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join([*common[: rng.choice([0, 30, 60])], *told]))
    sets = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    frequency = Counter(s for c in sets for s in c)
    monkeypatch.setattr(minhash, "FLOOR", 4)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    span = np.log(len(texts) / 4)
    weight = {s: 1 - minhash.DAMP * min(max(np.log(max(f / 4, 1)) / span, 0), 1) for s, f in frequency.items()}

    def roots(of):
        root = list(range(len(texts)))
        alike = [(i, j) for i in range(len(texts)) for j in range(i) if sum(of[s] * min(n, sets[j][s]) for s, n in sets[i].items()) >= 0.8 * sum(of[s] * max(sets[i][s], sets[j][s]) for s in sets[i] | sets[j]) - 1e-9]
        for _ in texts:
            for i, j in alike:
                root[i] = root[j] = min(root[i], root[j])
        return root

    want = roots(weight)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and want != roots(dict.fromkeys(weight, 1.0)) and len(set(want)) < len(texts)
