"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read, stage


def op2_secrets(spark, sf_dir):
    from .secrets import KINDS, secret_spans
    from .spans import joined

    def n(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return secret_spans(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"),
    )


def op3_pii(spark, sf_dir):
    from .pii import KINDS, pii_spans
    from .spans import joined

    def n(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    def by_kind(spans):
        """kind:start:end by kind and then start."""
        turned = F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
        return joined(turned, KINDS)

    return pii_spans(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(by_kind("base"), 256).alias("base_sha256"), by_kind("spans").alias("spans"),
    )


def op4_pivots(spark, sf_dir):
    from .pivots import embedding_groups

    found = embedding_groups(read(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op5_simhash(spark, sf_dir):
    from .simhash import simhash_groups

    found = simhash_groups(read(spark, sf_dir, "documents"), width=3, words=1, radius=2)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op1_chat(spark, sf_dir):
    from .chat import chat_format, chat_read

    both = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_read(chat_format(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def trusted_labels():
    """Rows that labels may be learnt from, by the id alone."""
    return F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) != 0


def op6_quality(spark, sf_dir):
    from .quality import fit_quality, quality_scores

    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs, read(spark, sf_dir, "labels"), trusted_labels())
    return quality_scores(docs, model).select(
        F.col("id").alias("doc_id"), (~trusted_labels()).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_lines(spark, sf_dir):
    from .line_dedup import line_report

    n, left = F.size("worded").cast("long"), F.size("kept").cast("long")
    return line_report(read(spark, sf_dir, "documents")).select(
        "doc_id", n.alias("n_lines"), left.alias("n_kept"), (n - left).alias("n_removed"),
        F.array_join(F.transform("kept", lambda k: k.cast("string")), ",").alias("kept_lines"),
    )


def op8_packing(spark, sf_dir):
    from .packing import pack

    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_bpe(spark, sf_dir):
    from .bpe import bpe_roundtrip
    from .tokens import word_path

    got = bpe_roundtrip(read(spark, sf_dir, "documents"), word_path())
    return got.select(
        F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_variants(spark, sf_dir):
    from .variants import spelling_variants, words_of

    return spelling_variants(stage(words_of(read(spark, sf_dir, "documents")), "words"))


def op12_rules(spark, sf_dir):
    from .rules import ledger, passes

    kept = passes(F.col("failed"), "v2")
    return ledger(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), "base")).alias("base_failed"), kept.alias("kept"), "failed",
    )


def rule_ablation(spark, sf_dir):
    """What each rule of each policy drops by itself, from the ledger's bits."""
    from .rules import ablation, ledger

    return ablation(ledger(read(spark, sf_dir, "documents")))


def op13_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (op1_chat, op2_secrets, op3_pii, op4_pivots, op5_simhash, op6_quality, op7_lines, op8_packing, op9_exact_dedup, op10_bpe, op11_variants, op12_rules, op13_whitening, rule_ablation)}

#: Measurements of documents, whether rules fail, and their bits, as in rules.py.
_LEDGER = r"""
    d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    runs AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS run FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
    again AS (SELECT row, i FROM runs QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
    covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY row),
    m AS (SELECT doc_id, len(words) AS n_words, list_sum(list_concat([0::BIGINT], list_transform(words, lambda x: length(x))))::BIGINT AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
          FROM w LEFT JOIN covered USING (row)),
    b AS (SELECT *, n_words < 20 AS f0, 100 * n_repeat_words > 30 * n_words AS f1, 10 * n_symbols > n_words AS f2, n_lines >= 10 AND 100 * n_dup_lines > 50 * n_lines AS f3,
                 10 * n_capitals > 6 * n_letters AS f4, 2 * n_letters < word_chars AS f5, word_chars > 30 * n_words AS f6 FROM m),
    l AS (SELECT *, (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT)::BIGINT AS failed FROM b)"""

#: crc32 of a short text of code points below 2,048, byte by byte.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT]
    ELSE [(192 + (ord(ch) >> 6))::BIGINT, (128 + (ord(ch) & 63))::BIGINT] END))), lambda c, x: xor(c >> 8, crc_table.v[(xor(c, x) & 255) + 1])), 4294967295)"""

ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
        FROM t JOIN g ON t.h = g.h""",
    "op11_variants": rf"""
        WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS v),
        found AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        per AS (SELECT id, run, count(*) AS n FROM found GROUP BY ALL),
        hashed AS (SELECT run, n, {_CRC.format("id || ':' || run")} AS h FROM per, crc_table),
        slipped AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        short AS (SELECT DISTINCT c.word, w.word AS near FROM cuts c JOIN words w ON w.word = c.rest),
        pairs AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                  UNION SELECT word, near FROM short UNION SELECT near, word FROM short),
        best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
        formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
        steps AS (SELECT word, word AS at FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s USING (word) JOIN formed e ON e.word = s.at AND e.form IS NULL""",
    "op12_rules": f"""
        WITH {_LEDGER}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed, failed = 0 AS kept, failed FROM l""",
    "rule_ablation": f"""
        WITH {_LEDGER}, rules AS (SELECT k, r FROM (VALUES (0, 'few_words'), (1, 'repeated_words'), (2, 'symbols'), (3, 'repeated_lines'), (4, 'capitals'), (5, 'few_letters'), (6, 'long_words')) AS t(k, r)),
        policies AS (SELECT policy, "all" FROM (VALUES ('base', 3), ('v1', 55), ('v2', 127)) AS t(policy, "all")),
        a AS (SELECT policy, r AS rule, "all", (1 << k) AS own FROM policies, rules WHERE ("all" >> k) & 1 = 1)
        SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (failed & own <> 0) AS n_failed, count(*) FILTER (failed & "all" = own) AS n_alone,
               count(*) FILTER (failed & "all" = 0) AS n_kept, count(*) FILTER (failed & "all" & ~own = 0) AS n_kept_without
        FROM a, l GROUP BY policy, rule""",
}
