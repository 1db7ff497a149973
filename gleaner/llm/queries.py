"""Registered queries of the operators, ``opN_<name>``, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.alignment import token_alignment
from gleaner.llm.cascade import cascade
from gleaner.llm.decontaminate import contaminated
from gleaner.llm.divergence import source_divergence
from gleaner.llm.exactdedup import remove_repeats
from gleaner.llm.linededup import near_lines
from gleaner.llm.lm import lm_scores
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.mixing import mix
from gleaner.llm.quality import quality
from gleaner.llm.sketch import edited_fingerprints
from gleaner.llm.text import WORD
from gleaner.llm.toxicity import toxicity
from gleaner.llm.urllists import filter_captures
from gleaner.session import ensure_shipped, table

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_shipped(spark)
            return f(spark, sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
win AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d AS g
  FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL)
  WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (
  SELECT t.doc_id, t.text, len(w) AS n_words,
         CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 25 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 30 * n_lines
    OR len(regexp_extract_all(text, '[A-Z]')) > len(regexp_extract_all(text, '[a-z]'))
    OR 100 * len(regexp_extract_all(text, '!')) > 50 * n_words
    OR 100 * len(regexp_extract_all(text, '[0-9]')) > 20 * word_chars
    OR 100 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 70 * n_words
    OR 200 * len(regexp_extract_all(text, '[.!?:;]')) < n_words) AS kept
FROM b
"""


@register("op10_quality_cascade", OP10_SQL)
def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over ``documents``: base metrics and the cascade's verdict."""
    out = cascade(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: Production targets of the mix: shares by language and topic, sources flattened.
MIX_TARGETS = {
    "source": 0.5,
    "lang": {"en": 0.62, "de": 0.14, "fr": 0.14, "es": 0.10},
    "topic": {"prose": 0.90, "table": 0.03, "notice": 0.02, "technical": 0.05},
}


def topic(text):
    """A stand-in for a topic (the table has none): three substring tests."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("!!"), "notice")
        .when(t.contains("@") | t.contains("="), "technical")
        .otherwise("prose")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """Documents raked and drawn with the production targets."""
    return mix(
        docs,
        {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))},
        MIX_TARGETS,
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)),
        F.col("doc_id"),
    )


def _mix_sql(sweeps: int = 40) -> str:
    """The fit unrolled: a sweep is one window per dimension."""

    def given(d):
        return "CASE " + d + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX_TARGETS[d].items()) + " END"

    def listed(d):
        """A category without a target keeps its tokens' worth beside the listed ones."""
        return (
            f"coalesce(g_{d}, t_{d} * (SELECT CASE WHEN sum(t) > 0 THEN sum(g) / sum(t) ELSE 1 END "
            f"FROM (SELECT DISTINCT {d}, g_{d} AS g, t_{d} AS t FROM own WHERE g_{d} IS NOT NULL AND t_{d} > 0)))"
        )

    w = "SELECT source, lang, topic, tokens, s_source, s_lang, s_topic, CAST(tokens AS DOUBLE) AS mass FROM shares"
    for _ in range(sweeps):
        for d in ("source", "lang", "topic"):
            w = (
                f"SELECT * EXCLUDE (m, mass), CASE WHEN m > 0 THEN mass * s_{d} / m ELSE 0 END AS mass "
                f"FROM (SELECT *, sum(mass) OVER (PARTITION BY {d}) AS m FROM ({w}))"
            )
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!!') THEN 'notice'
         WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '=') THEN 'technical'
         ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL),
own AS MATERIALIZED (
  SELECT *, {given("lang")} AS g_lang, {given("topic")} AS g_topic,
    CAST(sum(tokens) OVER (PARTITION BY lang) AS DOUBLE) AS t_lang, CAST(sum(tokens) OVER (PARTITION BY topic) AS DOUBLE) AS t_topic
  FROM cells),
raw AS (
  SELECT *, sqrt(sum(tokens) OVER (PARTITION BY source)) AS r_source, {listed("lang")} AS r_lang,
    {listed("topic")} AS r_topic FROM own),
shares AS MATERIALIZED (
  SELECT source, lang, topic, tokens,
    r_source / (SELECT sum(r) FROM (SELECT DISTINCT source, r_source AS r FROM raw WHERE tokens > 0)) AS s_source,
    r_lang / (SELECT sum(r) FROM (SELECT DISTINCT lang, r_lang AS r FROM raw WHERE tokens > 0)) AS s_lang,
    r_topic / (SELECT sum(r) FROM (SELECT DISTINCT topic, r_topic AS r FROM raw WHERE tokens > 0)) AS s_topic
  FROM raw),
fit AS MATERIALIZED ({w}),
g AS (
  SELECT source, lang, topic,
    CASE WHEN tokens > 0 THEN mass * (SELECT sum(tokens) FROM cells) / tokens ELSE 0 END AS weight FROM fit)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight,
  CAST(floor(weight + CAST(('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT)
       / 4294967296.0) AS BIGINT) AS n_copies
FROM t JOIN g USING (source, lang, topic)
"""


@register("op2_mixing", _mix_sql())
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over ``documents``: calibrated weight and drawn copies of every document."""
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), "n_copies"
    )


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a fetch date each (stand-in: the table has none)."""
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("page_id") * 37 % 2000).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list entry from every row of ``pages`` (stand-in: no list is given)."""
    page = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("url"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    first = F.regexp_extract("url", "^[a-z]+://([^/?#:]+/[^/?#]+)", 1)
    return page.select(
        F.concat(F.lit("list"), (F.col("page_id") % 7).cast("string")).alias("list_name"),
        F.when(F.col("page_id") % 4 == 0, "host").when(F.col("page_id") % 4 == 1, "domain").otherwise("prefix").alias("kind"),
        F.when(F.col("page_id") % 4 == 0, host)
        .when(F.col("page_id") % 4 == 1, F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1))
        .otherwise(first)
        .alias("pattern"),
        F.when(F.col("page_id") % 5 < 3, "add").otherwise("remove").alias("action"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("page_id") * 13 % 1500).cast("int")).alias("entry_date"),
    )


OP3_SQL = r"""
WITH e AS (
  SELECT 'list' || (page_id % 7) AS list_name,
    CASE page_id % 4 WHEN 0 THEN 'host:' || regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1)
      WHEN 1 THEN 'domain:' || regexp_extract(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '([^.]+\.[^.]+\.[^.]+)$', 1)
      ELSE 'prefix:' || regexp_extract(lower(url), '^[a-z]+://([^/?#:]+/[^/?#]+)', 1) END AS key,
    page_id % 5 < 3 AS listed, DATE '2019-01-01' + CAST(page_id * 13 % 1500 AS INTEGER) AS day
  FROM pages),
daily AS (SELECT list_name, key, day, bool_and(listed) AS listed FROM e GROUP BY ALL),
spans AS (
  SELECT list_name, key, day, listed, lead(day) OVER (PARTITION BY list_name, key ORDER BY day) AS until FROM daily),
c AS (
  SELECT page_id, url, DATE '2019-01-01' + CAST(page_id * 37 % 2000 AS INTEGER) AS fetched_on,
    regexp_extract(lower(url), '^[a-z]+://([^?#]*)', 1) AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^([^/:]*)', 1) AS host, '/' || string_split(rest, '/')[2] AS step FROM c),
k AS (
  SELECT page_id, fetched_on, unnest(list_distinct(['host:' || host, 'domain:' || host,
    'domain:' || regexp_replace(host, '^[^.]*\.', ''), 'domain:' || regexp_replace(host, '^[^.]*\.[^.]*\.', ''),
    'prefix:' || host || step])) AS key FROM h),
hit AS (
  SELECT page_id, list_sort(list(DISTINCT list_name)) AS lists FROM k JOIN spans USING (key)
  WHERE listed AND fetched_on >= day AND (until IS NULL OR fetched_on < until) GROUP BY page_id)
SELECT page_id, url, fetched_on, coalesce(array_to_string(lists, ','), '') AS lists, lists IS NOT NULL AS blocked
FROM c LEFT JOIN hit USING (page_id)
"""


@register("op3_url_lists", OP3_SQL)
def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over ``pages``: the lists active at each capture's fetch date."""
    out = filter_captures(dated_captures(spark, sf_dir), dated_entries(spark, sf_dir))
    return out.select("page_id", "url", "fetched_on", F.array_join("lists", ",").alias("lists"), "blocked")


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over ``documents``: toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over ``documents``: quality score of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: every document of ``documents`` against every item of ``benchmark``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_minhash")
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over ``documents``: 2-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@register("op1_lm_scores")
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over ``documents``: interpolated bigram model and add-one base score."""
    return lm_scores(table(spark, sf_dir, "documents"), order=2)


@register("op4_exact_dedup")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over ``documents``: bytes of repeated 100-byte strings removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


@register("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all lines of ``documents``: classes, links within two edits, verdict."""
    return near_lines(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next
  FROM d WHERE doc_id IS NOT NULL WINDOW w AS (ORDER BY doc_id DESC, text)
  UNION ALL SELECT doc_id, text, '' FROM d WHERE doc_id IS NULL),
t AS (
  SELECT row_number() OVER () AS r, doc_id, text, next, length(text) // 3 AS m,
    left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) AS edited FROM n),
x AS (SELECT r, 0 AS side, text AS s FROM t UNION ALL SELECT r, 1, edited FROM t UNION ALL SELECT r, 2, next FROM t),
w AS (
  SELECT r, side, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM x),
h AS (
  SELECT r, side, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [substr(md5(array_to_string(w, ' ')), 1, 12)]
    ELSE list_transform(range(1, len(w) - 3), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 12)) END AS h FROM w),
k AS (SELECT r, side, list_sort(list_distinct(h))[1:256] AS k FROM h),
p AS (
  SELECT t.*, a.k AS a, b.k AS b, c.k AS c,
    least(CASE WHEN len(a.k) >= 256 THEN a.k[256] END, CASE WHEN len(b.k) >= 256 THEN b.k[256] END) AS ab,
    least(CASE WHEN len(a.k) >= 256 THEN a.k[256] END, CASE WHEN len(c.k) >= 256 THEN c.k[256] END) AS ac
  FROM t JOIN k a ON a.r = t.r AND a.side = 0 JOIN k b ON b.r = t.r AND b.side = 1 JOIN k c ON c.r = t.r AND c.side = 2),
q AS (
  SELECT *, len(list_intersect(a, b)) AS both_ab, len(list_intersect(a, c)) AS both_ac,
    len(list_filter(a, lambda y: ab IS NULL OR y <= ab)) AS own_ab, len(list_filter(b, lambda y: ab IS NULL OR y <= ab)) AS its_ab,
    len(list_filter(a, lambda y: ac IS NULL OR y <= ac)) AS own_ac, len(list_filter(c, lambda y: ac IS NULL OR y <= ac)) AS its_ac
  FROM p)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN own_ab + its_ab - both_ab = 0 THEN 1.0::DOUBLE ELSE both_ab::DOUBLE / (own_ab + its_ab - both_ab) END AS near_edited,
  CASE WHEN own_ac + its_ac - both_ac = 0 THEN 1.0::DOUBLE ELSE both_ac::DOUBLE / (own_ac + its_ac - both_ac) END AS near_next,
  CASE WHEN len(a) = 0 THEN 1.0::DOUBLE WHEN own_ab > 0 THEN both_ab::DOUBLE / own_ab END AS kept_in_edited,
  CAST(CASE WHEN len(a) < 256 THEN len(a)
    ELSE floor((255 * 281474976710656.0::DOUBLE) / CAST(('0x' || a[256]) AS BIGINT)) END AS BIGINT) AS n_shingles
FROM q
"""


@register("op11_fingerprints", OP11_SQL)
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over ``documents``: sketches of every text, of its edited text and of the next one's."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tok AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 2 * v) AS p
  FROM dense JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts
QUALIFY part = 'pair' OR rank <= 10
"""


@register("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over ``documents``: divergence of the sources of each language, and their own terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over ``documents``: two tokenizers' groups and links, and the links' worth in the corpus."""
    return token_alignment(table(spark, sf_dir, "documents"))
