"""The corpus operators as queries over the tables, with production parameters and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, langid, lm, mixing, packing, probminhash, spherical, toxicity, urlfilter
from .common import fold

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    """The public vocabulary file that packing and chat formatting count with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), size=4096, windows=16)
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = langid.train(docs, ~held)
    told = langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    model = toxicity.train(docs, labels.where(~held))
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model, threshold=0.7).select("doc_id", "held_out", "score", "predicted")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = probminhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, words=5)
    return classes


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_sensitivity(table(spark, sf_dir, "documents")).drop("next_id")


#: Shares of the token budget: of domains, and of languages within each domain. Sources of a language share alike.
DOMAIN_WEIGHTS = {"web": 0.4, "forum": 0.2, "books": 0.3, "reference": 0.1}
LANG_WEIGHTS = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}
#: What all other languages of a domain share, among them texts that name none: as much as the smallest of those listed.
OTHER_LANGS = 0.15
MIX = {"fraction": 1.0, "epochs": 2, "seed": 20}


def domain() -> F.Column:
    """A source's domain: src0-4 web, src5-9 forum, src10-14 books, others reference."""
    number = F.expr("try_cast(substring(source, 4) as int)")
    return F.when(number < 5, "web").when(number < 10, "forum").when(number < 15, "books").otherwise("reference")


def n_words() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0))


def mix_weights(spark: SparkSession) -> tuple[DataFrame, DataFrame, None]:
    by_lang = [(d, k, w) for d in DOMAIN_WEIGHTS for k, w in [*LANG_WEIGHTS.items(), (None, OTHER_LANGS)]]
    return spark.createDataFrame(list(DOMAIN_WEIGHTS.items()), "domain string, weight double"), spark.createDataFrame(by_lang, "domain string, lang string, weight double"), None


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, n_words(), domain(), weights=mix_weights(spark), **MIX)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 1
    model = lm.train(docs, ~held, order=3)
    scored = lm.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_windows(chat.format_windows(given, tokenizer(), budget=2048, history=4))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filters": op9_url_filters,
    "op10_chat_formatting": op10_chat_formatting,
    "pipeline": pipeline,
}


def _fill_sql(name: str, parent: list[str], own: str, given: str) -> str:
    """CTEs ``{name}``: the budget of each node below ``given``, none above its capacity, siblings taking what others can't."""
    path = ", ".join([*parent, own])
    by = ", ".join(parent) or "1"
    join = " AND ".join(f"n.{p} = g.{p}" for p in parent) or "true"
    return f"""
{name}_n AS (SELECT {path}, sum(cap) AS cap, max(w_{own}) AS w FROM leaf GROUP BY {path}),
{name}_r AS (SELECT n.*, g.given, CASE WHEN w > 0 THEN cap / w END AS ratio FROM {name}_n n JOIN {given} g ON {join}),
{name}_s AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER o, 0) AS before, sum(w) OVER (PARTITION BY {by}) - coalesce(sum(w) OVER o, 0) AS rest
  FROM {name}_r WINDOW o AS (PARTITION BY {by} ORDER BY ratio NULLS LAST, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_l AS (SELECT *, CASE WHEN w > 0 AND rest > 0 AND (given - before) / rest < ratio THEN (given - before) / rest END AS lev FROM {name}_s),
{name}_f AS (SELECT *, max(lev) OVER (PARTITION BY {by}) AS fin FROM {name}_l),
{name} AS (SELECT {path}, CASE WHEN w = 0 THEN 0 WHEN fin IS NULL THEN cap ELSE least(cap, greatest(fin, 0) * w) END AS given FROM {name}_f)"""


def _case(column: str, weights: dict[str, float], otherwise: str = "0::DOUBLE") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in weights.items()) + f" ELSE {otherwise} END"


_NUMBER = "try_cast(substring(source, 4) AS INT)"
_LISTED = ", ".join(f"'{k}'" for k in LANG_WEIGHTS)
_MIX_SQL = f"""
WITH doc AS (SELECT doc_id, CASE WHEN {_NUMBER} < 5 THEN 'web' WHEN {_NUMBER} < 10 THEN 'forum' WHEN {_NUMBER} < 15 THEN 'books' ELSE 'reference' END AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS tokens FROM documents),
counted AS (SELECT * FROM doc WHERE tokens > 0),
held AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
others AS (SELECT domain, count(DISTINCT lang) AS n FROM held WHERE lang NOT IN ({_LISTED}) GROUP BY domain),
weighed AS (SELECT held.*, {_case("domain", DOMAIN_WEIGHTS)} AS w_domain, {_case("lang", LANG_WEIGHTS, f"{OTHER_LANGS}::DOUBLE / others.n")} AS w_lang, 1::DOUBLE AS w_source FROM held LEFT JOIN others USING (domain)),
leaf AS (SELECT *, CASE WHEN w_domain > 0 AND w_lang > 0 AND w_source > 0 THEN tokens::DOUBLE * {MIX["epochs"]} ELSE 0 END AS cap FROM weighed),
top AS (SELECT least({MIX["fraction"]}::DOUBLE * sum(tokens)::DOUBLE, sum(cap)) AS given FROM leaf),
{_fill_sql("d", [], "domain", "top")},
{_fill_sql("l", ["domain"], "lang", "d")},
{_fill_sql("s", ["domain", "lang"], "source", "l")},
spread AS (SELECT c.*, e.epoch::INT AS epoch, md5('{MIX["seed"]}:' || e.epoch || ':' || coalesce(c.doc_id::VARCHAR, '')) AS turn FROM counted c, (SELECT unnest(range({MIX["epochs"]})) AS epoch) e),
walked AS (SELECT p.*, floor(s.given)::BIGINT AS budget, coalesce(sum(p.tokens) OVER (PARTITION BY p.domain, p.lang, p.source ORDER BY p.epoch, p.turn, p.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM spread p JOIN s USING (domain, lang, source))
SELECT doc_id, domain, lang, source, epoch, tokens, least(tokens, budget - start)::BIGINT AS take_tokens, start FROM walked WHERE start < budget
"""

_RULE_FITS = "(n.host = r.host OR n.host LIKE '%.' || r.host) AND starts_with(n.path, r.start)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _key_sql(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    front = f"regexp_extract({bare}, '(?s)^(.*?://[^/?]*)', 1)"
    return f"CASE WHEN {front} <> '' THEN translate({front}, {_AZ}) || substr({bare}, length({front}) + 1) END"


def _parts_sql(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path"


_TARGET_SQL = """unnest(list_concat(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), list_concat(
    regexp_extract_all(html, '(?is)<link\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)[^>]*\\brel\\s*=\\s*["'']?canonical\\b', 1),
    regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1))))"""
#: As seen from the page; addresses with . and .. are left to the tests of the operator.
_AIMED_SQL = """CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN regexp_extract(src, '(?s)^(.*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(src, '(?s)^(.*?://[^/?]*)', 1) || t WHEN starts_with(t, '?') THEN regexp_extract(src, '(?s)^(.*?://[^?]*)', 1) || t WHEN starts_with(t, '#') THEN src
    ELSE regexp_extract(src, '(?s)^(.*?://[^/?]*)', 1) || '/' || regexp_extract(src, '(?s)^.*?://[^/?]*/((?:[^?]*/)?)', 1) || t END"""
_URL_SQL = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}) t(verdict, host, start)),
page AS (SELECT row_number() OVER () AS k, page_id, url, html, {_parts_sql("url")}, {_key_sql("url")} AS key FROM pages),
found AS (SELECT key AS src, {_TARGET_SQL} AS t FROM page WHERE key IS NOT NULL),
aimed AS (SELECT src, {_AIMED_SQL} AS t FROM found WHERE t <> ''),
link AS (SELECT DISTINCT src, {_key_sql("t")} AS dst FROM aimed),
sides AS (SELECT src AS a, dst AS b FROM link WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM link WHERE dst IS NOT NULL AND src <> dst),
reach(node, other) AS (SELECT a, a FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON r.other = s.a),
known AS (SELECT DISTINCT other, {_parts_sql("other")} FROM reach),
says AS (SELECT n.other, arg_max(r.verdict, length(r.host || r.start)) AS verdict FROM known n JOIN rules r ON {_RULE_FITS} GROUP BY n.other),
alias AS (SELECT r.node, CASE WHEN bool_or(s.verdict = 'allow') THEN 'allow' WHEN bool_or(s.verdict = 'block') THEN 'block' END AS verdict FROM reach r JOIN says s ON r.other = s.other GROUP BY r.node),
ruled AS (SELECT n.k, arg_max(r.verdict, length(r.host || r.start)) AS verdict, arg_max(r.host || r.start, length(r.host || r.start)) AS rule FROM page n JOIN rules r ON {_RULE_FITS} GROUP BY n.k)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, a.verdict, 'allow') AS verdict
FROM page p LEFT JOIN ruled r ON p.k = r.k LEFT JOIN alias a ON p.key = a.node
"""

_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, other) AS (SELECT a, a FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a),
component AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(vec_id = coalesce(least, vec_id), false) AS kept
FROM v LEFT JOIN degree ON a = vec_id LEFT JOIN component ON node = vec_id
"""

ORACLE: dict[str, str] = {"op2_embedding_near_dedup": _VECTOR_SQL, "op7_mixing": _MIX_SQL, "op9_url_filters": _URL_SQL}
