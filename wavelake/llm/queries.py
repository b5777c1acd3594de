"""The contract queries over the text operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.collocations import collocations
from wavelake.llm.decontam import find_contaminated
from wavelake.llm.htmltext import extract_main_text
from wavelake.llm.lexical import rank_documents
from wavelake.llm.licenses import COPYRIGHT_LINE, COPYRIGHT_PROSE, KNOWN, SPELLINGS, scan_licenses
from wavelake.llm.linededup import dedup_lines
from wavelake.llm.minhash import near_duplicates
from wavelake.llm.mixing import mix
from wavelake.llm.pii import KINDS, find_private
from wavelake.llm.quality import MIN_DOCS, score_quality
from wavelake.llm.substring import dedup_substrings
from wavelake.llm.toxicity import CUT, held_out, score_toxicity
from wavelake.llm.urlfilter import RULES, filter_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), percent=85)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_pages(spark, sf_dir)).select("page_id", "url", "text", "n_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored, _ = score_toxicity(_documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= CUT).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    counts = F.col(out.columns[-1])
    return out.select("doc_id", counts["n_lines"].alias("n_lines"), counts["n_dropped"].alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_pages(spark, sf_dir)).drop("trust", "distrust")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir)).drop("n_lines")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(_documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col(found.columns[-1])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"))


def private_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op13_private_data`` that SQL can express: what the patterns find in all documents."""
    return op13_private_data(spark, sf_dir).drop("spans")


def quality_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_quality_rules`` with thresholds of their own for groups from five documents on."""
    return score_quality(_documents(spark, sf_dir), min_docs=5).drop("n_lines")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op2_source_mix`` that SQL can express: sizes and targets of all documents."""
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_html_text": op5_html_text,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_private_data": op13_private_data,
    "private_base": private_base,
    "quality_small_groups": quality_small_groups,
    "mix_targets": mix_targets,
}

_OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.v WHERE reach.r < e.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = d.doc_id
"""

_OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND c.keeper <> l.doc_id AS gone
  FROM lines l LEFT JOIN common c ON c.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), E'\n'), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g,
         unnest(range(1, len(w) - 3)) AS i
  FROM texts WHERE len(w) >= 5),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM wins),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) WHERE k >= 2 GROUP BY doc_id),
c AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN hit ON hit.doc_id = t.doc_id),
r AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS r1, coalesce(n_symbols / nullif(n_words, 0), 0) AS r2,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS r3, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS r4
  FROM c),
e AS (
  SELECT lang, source, unnest([1, 2, 3, 4]) AS ratio, unnest([r1, r2, r3, r4]) AS v FROM r WHERE n_words > 0),
b AS (SELECT lang, source, ratio, CASE WHEN v > 1e-8 THEN ceil(ln(v) / ln(1.01 / 0.99)) ELSE -1000 END AS bin FROM e),
q AS (
  SELECT grouping_id(lang, source) AS level, lang, source, ratio, count(*) AS docs,
         pow(CAST(1.01 AS DOUBLE) / 0.99, quantile_cont(bin, 0.25)) AS a, pow(CAST(1.01 AS DOUBLE) / 0.99, quantile_cont(bin, 0.75)) AS z
  FROM b GROUP BY GROUPING SETS ((lang, source, ratio), (lang, ratio), (ratio)) HAVING count(*) >= $min_docs),
t AS (
  SELECT level, lang, source, ratio, a - 10 * greatest(z - a, s) AS lo, z + 10 * greatest(z - a, s) AS hi
  FROM (SELECT *, CASE ratio WHEN 1 THEN 0.3 WHEN 2 THEN 0.03 WHEN 3 THEN 0.04 ELSE 0.02 END AS s FROM q)),
x AS (
  SELECT r.doc_id, max(t.level) FILTER (WHERE FALSE) AS unused, list(struct_pack(level := t.level, ratio := t.ratio, lo := t.lo, hi := t.hi)) AS bs
  FROM r JOIN t ON (t.level = 3) OR (t.level = 1 AND t.lang IS NOT DISTINCT FROM r.lang)
       OR (t.level = 0 AND t.lang IS NOT DISTINCT FROM r.lang AND t.source IS NOT DISTINCT FROM r.source)
  GROUP BY r.doc_id),
f AS (
  SELECT doc_id, ratio, arg_min(lo, level) AS lo, arg_min(hi, level) AS hi
  FROM (SELECT doc_id, unnest(bs, recursive := true) FROM x) GROUP BY doc_id, ratio),
odd AS (
  SELECT r.doc_id FROM r JOIN f ON f.doc_id = r.doc_id
  WHERE (ratio = 1 AND (r1 > hi OR r1 < lo)) OR (ratio = 2 AND r2 > hi) OR (ratio = 3 AND r3 > hi) OR (ratio = 4 AND r4 > hi))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM odd) AS kept
FROM r
"""


def quality_sql(min_docs: int) -> str:
    """``op10_quality_rules`` for groups of at least ``min_docs`` documents."""
    return _OP10_SQL.replace("$min_docs", str(min_docs))


_OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents) d),
b AS (
  SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j, least(20, len(ws)) AS size, len(ws) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark) d
  WHERE len(ws) >= 13),
same AS (SELECT doc_id, item_id, i - j AS shift, j, size FROM w JOIN b ON w.word = b.word),
runs AS (
  SELECT doc_id, item_id, size,
         count(*) OVER (PARTITION BY doc_id, item_id, shift, size ORDER BY j RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS up,
         count(*) OVER (PARTITION BY doc_id, item_id, shift, size ORDER BY j) AS k
  FROM same),
short AS (
  SELECT doc_id, item_id, count(*) AS k FROM same WHERE size < 20
  GROUP BY doc_id, item_id, shift, size HAVING count(*) >= ceil(0.85 * size)),
hits AS (
  SELECT doc_id, item_id, max(up) AS overlap FROM runs WHERE size = 20 AND up >= 17 GROUP BY 1, 2
  UNION ALL SELECT doc_id, item_id, max(k) FROM short GROUP BY 1, 2)
SELECT d.doc_id, count(h.item_id) > 0 AS contaminated, count(h.item_id) AS n_items, coalesce(min(h.item_id), -1) AS first_item,
       CAST(coalesce(max(overlap), 0) AS INTEGER) AS overlap_words
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i,
         unnest([sha256(array_to_string(w[j : j + 34], ' ')) FOR j IN range(1, len(w) - 33)]) AS h
  FROM words WHERE len(w) >= 35),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM wins) WHERE n > 1),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
near AS (
  SELECT p.doc_id, p.i, p.word, t.i AS last
  FROM pos p ASOF LEFT JOIN twice t ON p.doc_id = t.doc_id AND p.i >= t.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE last IS NOT NULL AND i - last < 35) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 35) AS t
  FROM near GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


#: For tables whose pages link to no other host, as the given ones: ranks then are those of the seeds.
_OP9_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) r(h, s, v)),
fits AS (
  SELECT u.host, u.path, h || s AS rule, v, row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(h || s) DESC, length(h) DESC, v DESC) AS k
  FROM (SELECT DISTINCT host, path FROM p WHERE host <> '') u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, s)),
ruled AS (SELECT p.*, rule, v FROM p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND k = 1),
bad AS (SELECT host FROM ruled WHERE host <> '' GROUP BY host HAVING 2 * count(*) FILTER (WHERE v = 'block') > count(*))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
-- sources reach their cap in the order of size over weight
o AS (SELECT *, 2.0 * source_size AS most, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
a AS (SELECT *, coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             1.5 * sum(source_size) OVER () AS total FROM o),
l AS (SELECT max((total - full_before) / rest) FILTER (WHERE (total - full_before) / rest * weight <= most) AS level FROM a),
t AS (SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target FROM a, l)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(CAST(target AS DOUBLE), 4) AS target
FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines_sql(text: str) -> str:
    """The lines of a text that count, lower-cased, as words with single spaces (a DuckDB expression)."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lines = f"list_filter(string_split({low}, chr(10)), lambda l: NOT regexp_matches(l, {_quoted(COPYRIGHT_LINE)}) OR regexp_matches(l, {_quoted(COPYRIGHT_PROSE)}))"
    return f"list_filter(list_transform({lines}, lambda l: trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g'))), lambda l: l <> '')"


def _spelled_sql(words: str) -> str:
    out = f"' ' || {words} || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


_OP4_SQL = f"""
WITH known AS (
  SELECT {_spelled_sql(f"array_to_string({_lines_sql('t')}, ' ')")} AS form, min(license) AS license
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)}) k(license, t) GROUP BY 1),
docs AS (SELECT doc_id, {_lines_sql("coalesce(text, '')")} AS ls FROM documents),
whole AS (SELECT doc_id, sha256({_spelled_sql("array_to_string(ls, ' ')")}) AS digest FROM docs),
starts AS (
  SELECT doc_id, i, {_spelled_sql("array_to_string(string_split(array_to_string(ls[i : i + 499], ' '), ' ')[1 : 1000], ' ')")} || ' ' AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
best AS (SELECT doc_id, i, arg_max(license, len(string_split(form, ' '))) AS license FROM starts JOIN known ON starts_with(words, form || ' ') GROUP BY doc_id, i),
notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM best GROUP BY doc_id)
SELECT w.doc_id, w.digest, coalesce(k.license, '') AS license, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notice_licenses
FROM whole w LEFT JOIN known k ON sha256(k.form) = w.digest LEFT JOIN notices n ON n.doc_id = w.doc_id
"""

_OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS n, row_number() OVER () AS k, ws FROM w WHERE len(ws) > 0),
c AS (SELECT count(*) AS n_docs, sum(n) AS length FROM d),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs),
i AS (
  SELECT p.k, doc_id, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * n_docs) // length AS BIGINT)))) AS impact
  FROM p JOIN f ON f.term = p.term JOIN d ON d.k = p.k, c),
s AS (SELECT item_id, k, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i ON i.term = q.term GROUP BY item_id, k, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

_OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[: k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM c, range(1, 5) r(k) WHERE k < len(w)),
s AS (
  SELECT cuts.lang, cuts.phrase, a, cuts.k, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN t ON t.lang = cuts.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s),
inner_of AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS a
  FROM c, range(2, 5) r(k), range(1, 5) q(i) WHERE k < len(w) AND i + k - 1 <= len(w) GROUP BY ALL),
kept AS (SELECT * FROM low WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM inner_of o WHERE o.lang = low.lang AND o.phrase = low.phrase AND o.a >= low.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

_PRIVATE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT * FROM (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
                            (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) r(place, kind, re)),
m AS (SELECT k, place, kind, regexp_extract_all(t, re) AS found, string_split_regex(t, re) AS between FROM d, r WHERE regexp_matches(t, '[0-9@]')),
s AS (
  SELECT k, place, kind, found[i] AS span,
         CAST(list_sum(list_transform(between[: i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[: i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
g AS (SELECT *, regexp_replace(span, '[^0-9]', '', 'g') AS digits FROM s),
ok AS (
  SELECT * FROM g WHERE kind = 'email' OR (kind = 'phone' AND length(digits) BETWEEN 8 AND 15)
  OR (kind = 'ip' AND len(list_filter(string_split(span, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0)
  OR (kind = 'card' AND length(digits) BETWEEN 16 AND 19
      AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INT WHEN digits[-i]::INT > 4 THEN 2 * digits[-i]::INT - 9 ELSE 2 * digits[-i]::INT END)) % 10 = 0))
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || start + length(span), ',' ORDER BY place, start), '')) AS base_sha256
FROM d LEFT JOIN ok ON ok.k = d.k GROUP BY d.k
"""

ORACLE_SQL = {
    "private_base": _PRIVATE_SQL,
    "op12_collocations": _OP12_SQL,
    "op11_ranked_search": _OP11_SQL,
    "op4_license_scan": _OP4_SQL,
    "op3_substring_dedup": _OP3_SQL,
    "op8_decontaminate": _OP8_SQL,
    "op10_quality_rules": quality_sql(MIN_DOCS),
    "quality_small_groups": quality_sql(5),
    "op9_url_filter": _OP9_SQL,
    "mix_targets": _MIX_SQL,
    "op1_minhash_dedup": _OP1_SQL,
    "op7_line_dedup": _OP7_SQL,
}
