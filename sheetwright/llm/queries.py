"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    fill_in_middle,
    ftrl_quality,
    hmm_lm,
    license_scan,
    line_dedup,
    mixing,
    periodic_runs,
    permutation_index,
    piece_transducer,
    quality_rules,
    secret_scan,
    simhash,
)
from .common import WORD, n_words, table


#: Model file of the SentencePiece queries.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = permutation_index.usable(table(spark, sf_dir, "embeddings"))
    return permutation_index.nearest_found(rows, rows.filter("id % 50 = 0"), k=5)


def op2_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"), F.xxhash64("text").alias("tie"))
    mix = mixing.mix_sources(docs, size="n")
    return mix.select("doc.doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.apply_rules(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_piece_transducer(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = piece_transducer.encode_texts(docs, piece_transducer.read_model(model))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op8_license_digest(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """folder: license texts beside the built-in short ones, in files named by their ids, where all executors can read them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan_licenses(docs, license_scan.known_licenses(spark, folder))
    return found.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ftrl_quality.classify_quality(docs, table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda col: F.sha2(col, 256)
    return rows.select(
        "doc.doc_id", "n", "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """The documents with periods planted in a tenth of them, as the contract of op12 says; a null doc_id plants none."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = docs.withColumns({"h": h, "ws": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))})
    n, g = F.size("ws"), F.floor(F.col("h") / 10)
    rows = rows.withColumns({"a": F.when(n > 0, g % n).cast("int"), "g": g})
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("ws", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    text = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = rows.select("doc.doc_id", "runs", "collapsed", top.alias("top"))
    length, start, period = F.col("top.length"), -F.col("top.col2"), -F.col("top.col3")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    rows = decontaminate.decontaminate(docs, items)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_permutation_index, op2_hmm_lm, op3_mix_sources, op4_quality_rules, op5_secret_scan, op6_simhash, op7_piece_transducer, op8_license_digest, op9_line_dedup, op10_ftrl_quality, op11_fill_in_middle, op12_periodic_runs, op13_decontaminate)}

_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP9 = f"""
WITH docs AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS d, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, d, unnest(ls) AS line, unnest(range(len(ls))) AS pos, len(ls) AS n FROM docs),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS k FROM lines),
repeated AS (SELECT k, max(d) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT d) >= 5),
marked AS (SELECT keyed.*, keeper IS NOT NULL AND keeper <> d AS dropped FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP3 = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS i FROM docs GROUP BY source),
ord AS (SELECT *, (SELECT 1.5::DOUBLE * sum(s)::DOUBLE FROM src)
    - coalesce(2 * sum(s) OVER (ORDER BY 2 * s::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over,
  sum(w) OVER (ORDER BY 2 * s::DOUBLE / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights,
  row_number() OVER (ORDER BY 2 * s::DOUBLE / w, i) AS k FROM src),
stop AS (SELECT left_over / weights AS share, k AS first_k FROM ord WHERE left_over / weights * w <= 2 * s ORDER BY k LIMIT 1),
tgt AS (SELECT source, s, CASE WHEN k >= (SELECT first_k FROM stop) THEN (SELECT share FROM stop) * w ELSE 2.0::DOUBLE * s END AS target FROM ord),
plan AS (SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // s END AS full_copies,
  CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % s END AS rest FROM tgt),
run AS (SELECT docs.*, plan.s, target, full_copies, rest,
  coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, s AS source_size, target,
  CAST((full_copies + CASE WHEN rest > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM run
"""


def _values(rows) -> str:
    return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)


def _canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace({_LOWER.format(text)}, '(?m){license_scan.STATEMENT}', '', 'g'), '(?m){license_scan.TITLE}', '', 'g')"
    out = f"regexp_replace({out}, '{license_scan.HYPHENS}', '-', 'g')"
    for other, usual in license_scan.SPELLINGS:
        out = f"replace({out}, '{other}', '{usual}')"
    return f"trim(regexp_replace({out}, '{license_scan.NO_WORD}', ' ', 'g'), ' ')"


def op8_sql(folder: str | None = None) -> str:
    """SQL of op8_license_digest with a folder of license texts."""
    files = f"UNION ALL SELECT 'text', sha256({_canonical('content')}), regexp_replace(regexp_extract(filename, '[^/]+$'), '[.](txt|md)$', '') FROM read_text('{folder}/*')" if folder else ""
    return f"""
WITH each AS (SELECT 'text' AS unit, sha256({_canonical("t")}) AS digest, i AS license_id FROM (VALUES {_values(license_scan.LICENSES)}) v(i, t) {files}
  UNION ALL SELECT 'line', sha256({_canonical("t")}), i FROM (VALUES {_values(license_scan.NOTICES)}) v(i, t)),
known AS (SELECT unit, digest, min(license_id) AS license_id FROM each GROUP BY ALL),
whole AS (SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e'))),
notes AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY pos) AS notices FROM lines
  JOIN known ON unit = 'line' AND digest = sha256({_canonical("line")}) WHERE regexp_matches(line, '(?i)licen[cs]e') GROUP BY doc_id)
SELECT whole.doc_id, whole.digest, known.license_id, coalesce(notices, '') AS notices FROM whole
LEFT JOIN known ON unit = 'text' AND known.digest = whole.digest LEFT JOIN notes ON notes.doc_id = whole.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(rank: int, pattern: str, group: int = 0) -> str:
    p = _quoted(pattern)
    return f"SELECT row, {rank} AS k, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS ps FROM docs"


# DuckDB's patterns have no lookaround: candidates are all maximal runs, and the filter asks for the digit and the length.
_OP5 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
found AS ({_matches(0, secret_scan.ASSIGN.replace("(?i:", "(?i)", 1)[:-1], 2)} UNION ALL {_matches(1, secret_scan.ACCESS)}
  UNION ALL {_matches(2, secret_scan.HEX)} UNION ALL {_matches(3, "[A-Za-z0-9+/_=-]+")}),
each AS (SELECT row, k, unnest(ms) AS m, unnest(ps) AS p, unnest(gaps[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM found),
placed AS (SELECT row, k, m, p, CAST(sum(length(g) + length(m)) OVER (PARTITION BY row, k ORDER BY i) AS BIGINT) AS stop FROM each),
longer AS (SELECT *, k = 3 AND length(m) >= 20 AND regexp_matches(m, '[0-9]') AND NOT ({" OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in secret_scan.ALLOWED)})
  AND NOT (regexp_matches(m, {_quoted(secret_scan.SLUG)}) AND NOT regexp_matches(m, {_quoted(secret_scan.SIDE_BY_SIDE)})) AS candidate FROM placed),
judged AS (SELECT *, CASE WHEN candidate THEN list_max(list_transform(range(1, length(m) - 18), lambda j: list_aggregate(string_split(substr(m, j, 20), ''), 'entropy'))) END AS e FROM longer),
spans AS (SELECT row, k, stop - length(m) AS start, stop, (['assign', 'access', 'hex', 'entropy'])[k + 1] || ':' || CAST(stop - length(m) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS s FROM judged
  WHERE CASE k WHEN 0 THEN length(p) >= {secret_scan.ASSIGN_LEAST} WHEN 3 THEN candidate AND e >= CASE {" ".join(f"WHEN regexp_matches(m, {_quoted(p)}) THEN {b}" for p, b in secret_scan.CLASSES[:-1])} ELSE {secret_scan.CLASSES[-1][1]} END ELSE true END)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, k), '') AS spans
FROM docs LEFT JOIN spans USING (row) GROUP BY row
"""

_OP11 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM docs),
nums AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM nums),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""

# A run's words are equal one period apart: equal words of a text are paired, pairs counted by distance, and stretches of them joined.
_OP12 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda acc, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(acc, b)), 4294967295), 4294967295) AS h FROM documents),
places AS (SELECT *, len(ws) AS n, (h // 10) % greatest(1, len(ws)) AS a FROM docs),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
words AS (SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM periods, unnest(range(n)) t(i)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
often AS (SELECT r, q FROM pairs GROUP BY r, q HAVING count(*) >= greatest(6 - q, 3 * q)),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS n FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs SEMI JOIN often USING (r, q)) GROUP BY r, q, g),
runs AS (SELECT r, s, n, min(q) AS q FROM stretches WHERE n >= greatest(6, 4 * q) GROUP BY r, s, n),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
found AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_max({'s': s, 'n': n, 'q': q}, [n, -s, -q]) AS top FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.n AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period,
  CAST(1000 * top.n // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""

_OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, array_to_string(ws[i + 1:i + 10], ' ') AS w, least(len(ws), 10) AS len FROM items, unnest(range(greatest(1, len(ws) - 9))) t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT len FROM wins),
spots AS (SELECT r, i, len, array_to_string(ws[i + 1:i + len], ' ') AS w FROM docs, lens, unnest(range(len(ws) - len + 1)) t(i)),
hits AS (SELECT DISTINCT r, i, len, w FROM spots SEMI JOIN wins USING (w, len)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + len)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits JOIN wins USING (w, len)) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

ORACLES = {"op11_fill_in_middle": _OP11, "op12_periodic_runs": _OP12, "op13_decontaminate": _OP13, "op5_secret_scan": _OP5, "op3_mix_sources": _OP3, "op8_license_digest": op8_sql(), "op9_line_dedup": _OP9}
