"""The pipeline's stages, one by one and together, against plain Python; on nulls, repeats, long texts, clashing columns and no rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from bondsight.llm import mixing

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, k1 long, win long, _source string, batch int, label int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "one benchmark passage that holds more than ten words in all, and then some more"


def data():
    rng = random.Random(9)
    good = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    bad = lambda n: " ".join("".join(rng.choice("!#$%&*") for _ in range(rng.randint(2, 5))) for _ in range(n))
    texts = [good(rng.randint(20, 80)) for _ in range(90)] + [bad(rng.randint(20, 80)) for _ in range(60)]
    labels = [(i, int(i < 90), 0) for i in range(150)]
    base = texts[0].split()
    near = list(base)
    near[len(base) // 2] = "changed"
    long_ = good(160)
    nearer = long_.split()
    nearer[80] = "changed"
    more = [texts[1], texts[1], " ".join(near), long_, " ".join(nearer), f"{good(12)} {ITEM.upper()} {good(9)}", None, None, "", "  \n", good(4000), good(3)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 8 else None, 0, "r", 0.1, 1, 2, "s", 3, 4) for i, t in enumerate(texts + more)]
    return [*rows, rows[5], (None, texts[2], None, None, None, None, None, None, None, None, None, None)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = data()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage gives, from what the one before gave."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out[name] = (docs, stage(spark, docs, folder))
        if i < 4:
            out[name][1].write.parquet(f"{folder}/stage{i}")
            docs = spark.read.parquet(f"{folder}/stage{i}")
            out[name] = (out[name][0], docs)
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_and_rows_are_carried(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert set(rows_of(after)) <= set(rows_of(before)), name


def test_quality_keeps_the_good(stages):
    before, after = (x.collect() for x in stages["quality"])
    kept = Counter(r.doc_id for r in after)
    assert all(i in kept for i in range(90)) and not any(i in kept for i in range(90, 150))
    rate = {r.doc_id in kept for r in before if r.text is None or r.text == ""}
    assert len(rate) == 1  # all texts without features are treated alike


def test_near_duplicates_keep_one_of_each(stages):
    before, after = (x.collect() for x in stages["near-duplicates"])
    sets = {}
    for r in before:
        w = SPACE.findall((r.text or "").translate(LOW))
        sets[(r.doc_id, r.text)] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None
    root = {k: k for k in sets}
    order = lambda k: (k[0] is None, k[0] or 0, k[1] is not None, k[1] or "")
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]), key=order)
                root = {k: low if v == high else v for k, v in root.items()}
    want = {k for k in sets if root[k] == k and not (k[0] is None and any(v == root[k] and x != k for x, v in root.items()))}
    assert Counter((r.doc_id, r.text) for r in after) == Counter(want)


def test_decontamination_drops_what_holds_a_window(stages):
    before, after = (x.collect() for x in stages["decontamination"])
    item = ALNUM.findall(ITEM.translate(LOW))
    wins = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = lambda t: not any(tuple(w[i : i + 10]) in wins for w in [ALNUM.findall((t or "").translate(LOW))] for i in range(len(w) - 9))
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if clean(r.text)) and len(after) < len(before)


def test_mixing_repeats_rows_as_planned(stages):
    before, after = stages["mixing"]
    times = {(r.doc_id, r.source, r.size): r.times for r in mixing.mix(before).collect()}
    want = Counter()
    for r in before.collect():
        want[tuple(r)] += times[(r.doc_id, r.source, len(SPACE.findall(r.text or "")))]
    assert rows_of(after) == +want


def test_token_files_hold_every_row(stages):
    from tokenizers import Tokenizer

    before, after = stages["token files"]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = Counter((r.doc_id, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes())) for r in before.collect())
    got = sorted(after.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_run_equals_its_stages(spark, folder, stages):
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(stages["token files"][1])


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
