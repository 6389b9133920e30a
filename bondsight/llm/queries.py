"""The queries of this subpackage: each applies one operator to its whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondsight.llm import covertree, decontaminate, linededup, minhash, mixing, periods, quality, shared, spelling, suffixarray, suffixtree, tokenbin, tokencount, windows
from bondsight.llm.shared import table

QUALITY_FOLDS, QUALITY_HELD = 3, 1
MODEL_FOLDS, MODEL_HELD = 7, 2


def byte_bpe() -> str:
    """The vocabulary file of the byte-level tokenizer; a parameter of the operator, here its usual place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> bytes | None:
    """Learned from labelled rows outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(shared.crc_rest(F.col("doc_id"), QUALITY_FOLDS) != QUALITY_HELD)
    return quality.train(table(spark, sf_dir, "documents"), labels.select("doc_id", F.col("quality").alias("label")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = (shared.crc_rest(F.col("doc_id"), QUALITY_FOLDS) == QUALITY_HELD).alias("held_out")
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), F.col("doc_id"), held)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared.shared_dir(spark)
    tokenbin.write_tokens(table(spark, sf_dir, "documents"), byte_bpe(), out)
    return tokenbin.read_tokens(spark, out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"), shared.crc_rest(F.col("doc_id"), MODEL_FOLDS) == MODEL_HELD)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.zipf_vocabulary(pieces()))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def periodic(docs: DataFrame) -> DataFrame:
    """docs with each tenth text (by crc32 of the id) made periodic from one of its words on, as the task's contract says."""
    docs = shared.documents(docs)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    w, g = F.col("w"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(shared.TEXT_WORDS), F.lit(0))))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    told = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(w, F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(told, " ")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find_runs(periodic(table(spark, sf_dir, "documents")), texts=False).drop("n_words", "runs", "collapsed")


def misspelt(words: DataFrame) -> DataFrame:
    """(doc_id, word) with one letter of each 199th (by crc32 of id and word) deleted, as the task's contract says."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    words = words.select("doc_id", "word", h.alias("h"), (h % F.length("word")).cast("int").alias("at"))
    less = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
    return words.select("doc_id", F.when(F.col("h") % 199 == 0, less).otherwise(F.col("word")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.vocabulary(misspelt(spelling.occurrences(table(spark, sf_dir, "documents")))))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_minhash, op3_quality, op4_substring_dedup, op5_token_files,
        op6_mixing, op7_suffix_tree, op8_token_counts, op9_cover_tree, op10_suffix_array,
        op11_periodic_runs, op12_spelling_variants, op13_line_dedup,
    )
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
iw AS (SELECT item_id, k, array_to_string(w[i0:i0 + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i0 FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i0, array_to_string(w[i0:i0 + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i0 FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, i0, dw.k, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i0, i0 + k)) AS pos FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i0, array_to_string(w[i0:i0 + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i0 FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i0 FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
x AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i0, i0 + 35)) AS pos FROM r)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM p ANTI JOIN x USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
o AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, hex(encode(concat(doc_id, ':', w))) AS x FROM o WHERE length(w) >= 6 GROUP BY 1, 2),
h AS (SELECT w, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
                                   lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) AS h FROM c, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b USING (less, i) WHERE a.word <> b.word
      UNION SELECT word, less FROM d WHERE less IN (SELECT word FROM v) UNION SELECT less, word FROM d WHERE less IN (SELECT word FROM v)),
f AS (SELECT p.word, near AS form, v.n AS form_n, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v ON p.near = v.word
      QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) = 1),
g AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root, 0 AS k FROM g UNION ALL SELECT r.word, g.form, k + 1 FROM r JOIN g ON r.root = g.word WHERE g.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(root, k) AS root FROM r GROUP BY 1) USING (word)""",
    "op13_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(w) AS line, unnest(range(len(w))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM b)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM b)), '')) AS kept_sha256
FROM k GROUP BY 1""",
}
