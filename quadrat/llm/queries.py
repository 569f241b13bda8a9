"""Registered queries of the text operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (bpe, brown_lm, divergence_rules, gray_simhash, host_paths, i_match, orchard_codes, packing,
                         phrase_sort, pu_toxicity, recompression, suffix_dedup, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_byte_bpe")
def op1(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)


def fold(folds: int):
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


@query("op2_brown_lm")
def op2(spark, sf):
    return brown_lm.score(table(spark, sf, "documents"), fold(5) != 1)


@query("op3_suffix_dedup")
def op3(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).drop("rest", "rest_text").withColumnRenamed(
        "rest_sha256", "kept_sha256")


@query("op4_best_fit_packing")
def op4(spark, sf):
    return packing.pack(table(spark, sf, "documents"), TOKENIZER, public_tokenizers.PATTERN)


@query("op5_host_paths")
def op5(spark, sf):
    return host_paths.extract(table(spark, sf, "pages"))


def quality_sql() -> str:
    """The rules and both references, step by step."""
    rules = divergence_rules
    lists = " ".join("WHEN '%s' THEN [%s]" % (lang, ", ".join(f"'{w}'" for w in own))
                     for lang, own in rules.COMMON.items())
    steps, left = [], "array_to_string(ws, '')"
    for pattern in rules.CLASSES.values():
        steps.append(left)
        left = f"regexp_replace({left}, '{pattern}', '', 'g')"
    chars = ", ".join(f"length({a}) - length({b})" for a, b in zip(steps, [*steps[1:], left]))

    def distance(name: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) / 2 ELSE 0e0 END"
        p, q = f"({name}[i] * 1e0 / list_sum({name}))", f"(ref_{name}[i] * 1e0 / list_sum(ref_{name}))"
        return f"""coalesce(CASE WHEN list_sum({name}) > 0 AND list_sum(ref_{name}) > 0 THEN sqrt(greatest(0e0, list_sum(list_transform(
          range(1, len({name}) + 1), lambda i: {part.format(p, q)} + {part.format(q, p)})))) ELSE 0e0 END, 0e0)"""
    far = " OR ".join(f"(n_words >= {least} AND {column} > {limit}e0)" for column, least, limit in rules.LIMITS)
    sizes = {"chars": len(rules.CLASSES) + 1, "common": len(rules.COMMON["en"]) + 1}
    sums = ", ".join("[%s] AS ref_%s" % (", ".join(f"coalesce(SUM({n}[{i + 1}]), 0)" for i in range(k)), n)
                     for n, k in sizes.items())

    def compared(ref: str) -> str:
        return f"""SELECT *, {far} AS far FROM (SELECT c.*, {distance('chars')} AS char_distance, {distance('common')} AS word_distance
          FROM counts c LEFT JOIN {ref} r ON c.lang IS NOT DISTINCT FROM r.ref_lang)"""
    return f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS s,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
      windows AS (SELECT rid, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {rules.WINDOW}),
      twice AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, ws[i:i + {rules.WINDOW - 1}]) AS n FROM windows) WHERE n > 1),
      repeats AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM twice, range({rules.WINDOW}) t(k) GROUP BY rid),
      lines AS (SELECT rid, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
      counts AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM (
        SELECT w.rid, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
          length(s) - length(regexp_replace(s, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
          coalesce(r.n, 0) AS n_repeat_words, [{chars}, length({left})] AS chars,
          list_append(hits, len(ws) - coalesce(list_sum(hits), 0)) AS common
        FROM (SELECT *, list_transform(coalesce(CASE lang {lists} END, CAST([] AS VARCHAR[])), lambda x: len(list_filter(ws, lambda y: y = x))) AS hits FROM w) w
        JOIN lines USING (rid) LEFT JOIN repeats r USING (rid))),
      ref1 AS (SELECT lang AS ref_lang, {sums} FROM counts WHERE NOT base_failed GROUP BY 1),
      near AS ({compared('ref1')}),
      ref2 AS (SELECT lang AS ref_lang, {sums} FROM near WHERE NOT base_failed AND NOT far GROUP BY 1)
      SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        NOT base_failed AND NOT far AS kept FROM ({compared('ref2')})"""


@query("op6_divergence_rules", quality_sql())
def op6(spark, sf):
    return divergence_rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_pu_toxicity")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    model = pu_toxicity.fit(docs, table(spark, sf, "labels"), fold(3) != 1)
    return pu_toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_token_counts")
def op8(spark, sf):
    return token_counts.by_limit(token_counts.histogram(
        table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN))


@query("op9_i_match")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    return i_match.edited_pairs(docs, i_match.lexicon(docs))


@query("op10_gray_simhash")
def op10(spark, sf):
    found = gray_simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def repeated_words_sql() -> str:
    """All windows of 50 words, joined by spaces, and the smallest doc_id of each."""
    span = recompression.WINDOW - 1
    return f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
      x AS (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
      windows AS (SELECT rid, doc_id, i, md5(s) AS s FROM (SELECT rid, doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i
          ROWS BETWEEN CURRENT ROW AND {span} FOLLOWING) AS s FROM x) WHERE i + {span} <= n),
      marks AS (SELECT rid, i, MIN(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM windows),
      kept AS (SELECT x.rid, x.i, x.word, coalesce(bool_or(again) OVER (PARTITION BY x.rid ORDER BY x.i ROWS BETWEEN {span} PRECEDING AND CURRENT ROW), false) AS gone
        FROM x LEFT JOIN marks USING (rid, i)),
      rest AS (SELECT rid, COUNT(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS s FROM kept WHERE NOT gone GROUP BY 1)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
      FROM w LEFT JOIN rest USING (rid)"""


@query("op11_recompression", repeated_words_sql())
def op11(spark, sf):
    return recompression.remove_repeated_words(table(spark, sf, "documents"))


def codes_sql() -> str:
    """Distances to all entries; each round is a pair of views."""
    parts, entries = orchard_codes.PARTS, orchard_codes.ENTRIES
    near = lambda book: f"""SELECT id, p, MIN(struct_pack(d := d, e := e)) AS best FROM (SELECT x.id, x.p, b.e, SUM((x.v - b.v) * (x.v - b.v)) AS d
        FROM cells x JOIN {book} b ON x.p = b.p AND x.j = b.j GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    moved = lambda book, found: f"""SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
        SELECT x.p, n.best.e AS e, x.j, CAST(floor(SUM(x.v)::DOUBLE / COUNT(*)) AS BIGINT) AS v FROM cells x JOIN {found} n ON n.id = x.id AND n.p = x.p GROUP BY 1, 2, 3) m
        ON m.p = b.p AND m.e = b.e AND m.j = b.j"""
    steps, book = [], "book0"
    for r in range(orchard_codes.ROUNDS):
        steps.append(f"near{r} AS MATERIALIZED ({near(book)}), book{r + 1} AS MATERIALIZED ({moved(book, f'near{r}')})")
        book = f"book{r + 1}"
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
      flat AS (SELECT id, unnest(range(len(embedding))) AS pos, len(embedding) // {parts} AS width, unnest(embedding) AS c FROM kept),
      cells AS MATERIALIZED (SELECT id, pos // width AS p, pos % width AS j, CAST(floor({orchard_codes.SCALE} * CAST(c AS DOUBLE)) AS BIGINT) AS v FROM flat),
      book0 AS MATERIALIZED (SELECT p, id - 1 AS e, j, v FROM cells WHERE id <= {entries}), {", ".join(steps)},
      last AS MATERIALIZED ({near(book)}),
      digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM {book}),
      coded AS (SELECT id, string_agg(lpad(format('{{:x}}', best.e), 2, '0'), '' ORDER BY p) AS code, CAST(SUM(best.d) AS BIGINT) AS error FROM last GROUP BY 1)
      SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
      FROM kept JOIN coded USING (id), digest"""


@query("op12_orchard_codes", codes_sql())
def op12(spark, sf):
    return orchard_codes.encode(table(spark, sf, "embeddings"))


def collocations_sql() -> str:
    """Every phrase of up to five words, counted."""
    p = phrase_sort
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces WHERE len(ws) >= {k})"
        for k in range(1, p.DEPTH + 1))
    return f"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
      pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs)),
      f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, COUNT(*) AS f FROM ({grams}) GROUP BY 1, 2),
      total AS (SELECT lang, SUM(len(ws)) AS n FROM pieces GROUP BY 1),
      often AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k, f AS a FROM f WHERE k > 1 AND f >= {p.LEAST}),
      cut AS MATERIALIZED (SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS lp, array_to_string(ws[c + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, k)) AS c FROM often)),
      known AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= {p.LEAST}),
      cuts AS (SELECT x.lang, x.phrase, x.a, x.c, l.f AS l, r.f AS r, total.n AS n, CAST(1000 AS HUGEINT) * x.a * total.n // (CAST(l.f AS HUGEINT) * r.f) AS score
        FROM cut x JOIN total ON total.lang = x.lang JOIN known l ON l.lang = x.lang AND l.phrase = x.lp JOIN known r ON r.lang = x.lang AND r.phrase = x.rp),
      worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
      parts AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, MAX(a) AS within FROM (
        SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM often)) GROUP BY 1, 2),
      ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM worst LEFT JOIN parts USING (lang, phrase) WHERE within IS NULL OR 100 * within < 100 * a)
      SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
        CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {p.TOP}"""


@query("op13_phrase_sort", collocations_sql())
def op13(spark, sf):
    return phrase_sort.collocations(table(spark, sf, "documents"))
