"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import grammar, licenses, linededup, mixing, packing, qda, quality, repair, runs, simhash, tokencounts, topk, toxicity
from tessera.llm.common import read
from tessera.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without cross-site boilerplate: doc_id, n_lines, n_removed, text."""
    return linededup.without_boilerplate(read(spark, sf_dir, "documents"), counts=True)


@query
def op2_branch_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(read(spark, sf_dir, "embeddings"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judged(read(spark, sf_dir, "documents")))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokencounts.token_counts(read(spark, sf_dir, "documents"))


@query
def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query
def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mixed(read(spark, sf_dir, "documents")))


@query
def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.looped(read(spark, sf_dir, "documents"))))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damaged(conv)), conv)


@query
def op13_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    grammar.write_tokens(read(spark, sf_dir, "documents"), path)
    return grammar.checksums(spark, path)


# rows numbered, lines that hold a word normalised, each with the checksum of all such lines of its text
LINES = r"""
with d as (select doc_id, source, text, row_number() over () as rid from documents),
l as (select rid, doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ix from d),
n as (select *, trim(regexp_replace(lower(line), '[ \t\n\v\f\r]+', ' ', 'g')) as nl from l),
x as (select rid, md5(string_agg(nl, chr(10) order by ix)) as ctx from n where nl <> '' group by rid),
c as (select n.*, ctx from n join x using (rid) where nl <> '')"""

SQL["op1_line_dedup"] = LINES + f""",
g as (select nl from c group by nl having count(distinct coalesce(source, chr(0))) >= {linededup.MIN_SITES} and count(distinct ctx) >= {linededup.MIN_CONTEXTS}),
k as (select n.rid, count(*) filter (n.nl <> '') as n_lines, count(g.nl) as n_removed, string_agg(n.line, chr(10) order by n.ix) filter (g.nl is null) as rest
  from n left join g using (nl) group by n.rid)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when n_removed > 0 then coalesce(rest, '') else text end as text
from d left join k using (rid)"""

SQL["op3_quality_rules"] = LINES + rf""",
s as (select rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
t as (select rid, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from s window o as (partition by rid order by i)),
r as (select rid, i from (select *, count(*) over (partition by rid, w, w2, w3) as times from t where w3 is not null) where times > 1),
rep as (select rid, count(distinct i + j) as n_repeat_words from r, (select unnest(range(3)) as j) group by rid),
words as (select rid, count(*) as n_words from s group by rid),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from n where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
f as (select source, nl from c group by source, nl having count(distinct (doc_id, md5(text))) > {quality.LINE_DOCS} and count(distinct ctx) > {quality.LINE_CONTEXTS}),
gone as (select c.rid, sum(len(string_split(c.nl, ' '))) as n_removed_words from c join f on f.nl = c.nl and f.source is not distinct from c.source group by c.rid),
a as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) as word_chars,
  coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  cast(coalesce(n_removed_words, 0) as bigint) as n_removed_words
  from d left join words using (rid) left join dup using (rid) left join rep using (rid) left join gone using (rid)),
b as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words as base_failed from a)
select *, not base_failed and 100 * (n_words - n_removed_words) >= {quality.MIN_LEFT} * n_words as kept from b"""

SQL["op2_branch_bound_topk"] = topk.SQL
