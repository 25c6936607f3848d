"""Registered document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.plans.registry import register

R6 = lambda df, *cols: df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})
c = F.col


def listing(t, split=False):
    """Files of each case folder, named ``<track>_<doc>_<part>.docx``."""
    name = F.concat(c("track").cast("string"), F.lit("_"), c("doc_id").cast("string"), F.when(c("doc_id") % 2 == 0, "_A").otherwise("_B"), F.lit(".docx"))
    df = t.docs.select(c("case_id").alias("folder_id"), name.alias("name"), "text")
    return D.split_folder(df, "src3", {"src3": "_A", "src3-B": "_B"}) if split else df.withColumn("case_id", c("folder_id"))


LIST = ", l as (select case_id as folder, case_id, track, doc_id, text, track||'_'||doc_id||case when doc_id%2=0 then '_A' else '_B' end||'.docx' as name from f_doc)"
LIST2 = LIST.replace("as folder, case_id,", "as folder, case when case_id='src3' and doc_id%2<>0 then 'src3-B' else case_id end as case_id,")
GRID = ", cs as (select distinct case_id from l), tr as (select unnest(range(1,10)) as track), grid as (select case_id, track from cs, tr)"


@register("s15_case_manifest", "f_doc", LIST2 + GRID + """
, m as (select case_id, track, max(name) as name from l group by all)
select case_id, string_agg(track||'='||coalesce(name,'-'), ';' order by track) as tracks, case when bool_or(track=1 and name is null) then 'MISSING_TRACK_1' else '' end as flags from grid left join m using (case_id, track) group by case_id""")
def _(t):
    m = D.manifest(listing(t, split=True))
    text = F.array_join(F.transform(F.map_entries("tracks"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"], F.lit("-")))), ";")
    return m.select("case_id", text.alias("tracks"), F.array_join("flags", ",").alias("flags"))


NAMES = "[" + ",".join("'" + n + "'" for n in D.TRACK_NAMES) + "]"
EVID = LIST + GRID + f""", first as (select case_id, track, min_by(text, name) as text from l group by all),
ev as (select case_id, '# CASE '||case_id||chr(10)||string_agg(chr(10)||repeat('=',72)||chr(10)||'## Track '||track||' — '||({NAMES})[track]||chr(10)||repeat('=',72)||chr(10)||coalesce(text, '[Track '||track||' was NOT provided for this case.]'), chr(10) order by track) as text from grid left join first using (case_id, track) group by case_id)"""


def evidence(t):
    l = listing(t)
    return D.evidence_text(l, l)


@register("s16_evidence_text", "f_doc", EVID + " select case_id, length(text) as n_chars, md5(text) as text_md5 from ev")
def _(t):
    return evidence(t).select("case_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("s17_evidence_summary", "f_doc", EVID + ", w as (select len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x<>'')) as w, contains(text,'was NOT provided for this case') as m from ev) select count(*) as cases, min(w) as min_words, max(w) as max_words, round(avg(w),6) as avg_words, count(*) filter (m) as cases_with_notice from w")
def _(t):
    s = D.evidence_summary(evidence(t))
    return R6(s.withColumns({x: c(x).cast("bigint") for x in ("min_words", "max_words")}), "avg_words")


@register("s17_evidence_run", "f_doc", EVID + """, w as (select len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x<>'')) as w, contains(text,'was NOT provided for this case') as m from ev),
f as (select string_agg(case_id || '-lost', ', ' order by case_id || '-lost') as failures from (select distinct case_id from ev))
select count(*) as cases, min(w) as min_words, max(w) as max_words, round(avg(w),6) as avg_words, count(*) filter (m) as cases_with_notice, (select failures from f) as failures from w""")
def _(t):
    """A manifest that names a further case without files for every case."""
    l = listing(t)
    lost = l.select(F.concat("case_id", F.lit("-lost")).alias("case_id"))
    s = D.evidence_run(l.select("case_id").unionByName(lost), l)
    return R6(s.withColumns({x: c(x).cast("bigint") for x in ("min_words", "max_words")}), "avg_words")


LANG = "(Mandarin|Cantonese|Chinese|Vietnamese|Arabic|Hindi|Punjabi|Thai|Spanish|Italian|Portuguese)"


@register("p12_noise_flags", "f_doc", LIST + GRID + f""", m as (select case_id, track, max_by(text, name) as text from l group by all), j as (select g.case_id, g.track, text from grid g left join m using (case_id, track))
select case_id, cast(track as int) as track, 'missing' as type, '' as detail from j where text is null
union all select case_id, cast(track as int), 'deficiency', cast(len(regexp_extract_all(text, '(?i)\\[DEFICIENC[A-Z]*[^\\]]*\\]')) as varchar) from j where len(regexp_extract_all(text, '(?i)\\[DEFICIENC[A-Z]*[^\\]]*\\]'))>0
union all select case_id, cast(track as int), 'language', unnest(list_distinct(regexp_extract_all(text, '\\b{LANG}\\b', 1))) from j where text is not null""")
def _(t):
    l = listing(t)
    return D.noise_flags(l, l)


@register("p13_case_hints", "f_doc", EVID + """
, h as (select case_id, [case when len(regexp_extract_all(text,'(?i)\\[DEFICIENC'))>0 then len(regexp_extract_all(text,'(?i)\\[DEFICIENC'))||' explicit [DEFICIENCY] marker(s)' end,
""" + ",".join(f"case when regexp_matches(text,'\\b{l}\\b') then 'non-English mention: {l}' end" for l in D.HINT_LANGUAGES) + """,
case when regexp_matches(text,'migration in progress|Jan 2025|>= 2 years|>=2 years') then 'possible retention/2-year issue (check dates)' end,
""" + ",".join(f"case when contains(text,'[Track {i} was NOT provided') then 'MISSING Track {i}' end" for i in range(1, 10)) + """] as h from ev)
select case_id, array_to_string(list_filter(h, lambda x: x is not null), '; ') as hints from h""")
def _(t):
    return D.case_hints(evidence(t)).select("case_id", F.array_join("hints", "; ").alias("hints"))


# ---- chunks ----------------------------------------------------------------------------------

def parts(t):
    """Every document as one part of its case: a track header and the text."""
    d = t.table("documents").select("doc_id", c("source").alias("case_id"), (1 + c("doc_id") % 9).cast("int").alias("track"), "text")
    text = F.concat(F.lit("## Track "), c("track").cast("string"), F.lit(" —\n\n"), c("text"))
    return d.select("case_id", c("track").alias("track_no"), "doc_id", text.alias("text"))


WORDS = "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w<>''))"


@register("w09_chunks", "", """
with recursive f_doc as (select doc_id, source as case_id, cast(1 + doc_id % 9 as int) as track, text from documents),
ln as (select case_id, track, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)),1) as ix from f_doc),
fl as (select *, not regexp_matches(line,'[a-zA-Z0-9]') as blank, starts_with(line,'### ') as hd from ln),
rc as (select *, sum(case when blank or hd then 1 else 0 end) over (partition by doc_id order by ix) as rec from fl),
kept as (select * from rc where not blank),
rt as (select case_id, track, doc_id, rec, trim(string_agg(line, chr(10) order by ix), ' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)) as text from kept group by all),
rw as (select *, """ + WORDS.format(x="text") + """ as words from rt),
ll as (select case_id, track, doc_id, rec, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)),1) as k from rw where words>280),
lw as (select *, """ + WORDS.format(x="line") + """ as w from ll),
gr as (select case_id, track, doc_id, rec, line, k, w, w as cum, 0 as grp from lw where k=1
  union all select l.case_id, l.track, l.doc_id, l.rec, l.line, l.k, l.w, case when g.cum+l.w>280 then l.w else g.cum+l.w end, case when g.cum+l.w>280 then g.grp+1 else g.grp end from gr g join lw l on l.doc_id=g.doc_id and l.rec=g.rec and l.k=g.k+1),
ch as (select case_id, track, doc_id, rec, 0 as grp, text from rw where words<=280 union all select case_id, track, doc_id, rec, grp, string_agg(line, chr(10) order by k) from gr group by case_id, track, doc_id, rec, grp)
select case_id, cast(track as int) as track, row_number() over (partition by case_id order by track, doc_id, rec, grp)-1 as chunk_id, length(text) as n_chars, md5(text) as text_md5 from ch""")
def _(t):
    ch = D.chunk_parts(parts(t), ["track_no", "doc_id"])
    return ch.select("case_id", "track", "chunk_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


# ---- policy ----------------------------------------------------------------------------------

def policy_parts(t):
    d = t.table("documents")
    head = F.concat(F.lit("\n"), (c("doc_id") % 12 + 1).cast("string"), F.lit("-"), (c("doc_id") % 16 + 1).cast("string"), F.lit("  Title "), c("lang"), F.lit("\n"))
    return d.select(c("source").alias("case_id"), c("doc_id").alias("part_no"), F.concat(head, "text").alias("text"))


SEC = """sec as (select source as case_id, row_number() over (partition by source order by doc_id)-1 as section_no, (doc_id%12+1)||'-'||(doc_id%16+1) as section, 'Title '||lang as title,
 rtrim((doc_id%12+1)||'-'||(doc_id%16+1)||'  Title '||lang||chr(10)||text, ' ') as text from documents)"""


@register("w10_policy_sections", "", "with " + SEC + " select case_id, section_no, section, title, md5(text) as text_md5 from sec")
def _(t):
    return D.split_sections(policy_parts(t)).select("case_id", "section_no", "section", "title", F.md5("text").alias("text_md5"))


@register("w10_section_guard", "", "with " + SEC + """, k as (select case_id, count(*) as n from sec group by 1 union all select distinct case_id || '-bare', 0 from sec)
select case_id, n as sections, n > 150 as passed from k""")
def _(t):
    """Every case, and for each a further one whose policy has no heading at all."""
    parts = policy_parts(t)
    bare = parts.select(F.concat("case_id", F.lit("-bare")).alias("case_id"), "part_no", F.lit("no heading stands here").alias("text"))
    both = parts.unionByName(bare)
    return D.section_guard(both, D.split_sections(both))


def citations(t, sections, mult=7):
    """Sections (cp * mult + k * 3) % n for k = 0 .. cp % 3 of every case."""
    n = sections.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    cp = n.withColumn("cp", F.explode(F.sequence(F.lit(1), F.lit(41)))).withColumn("k", F.explode(F.sequence(F.lit(0), c("cp") % 3)))
    element = F.when(c("cp") <= 7, "Element-1").when(c("cp") <= 16, "Element-2").when(c("cp") <= 28, "Element-3").otherwise("Element-4")
    return cp.select("case_id", "cp", element.alias("element"), ((c("cp") * mult + c("k") * 3) % c("n")).alias("section_no"))


def cite_sql(mult=7, name="cite"):
    return (f"{name} as (select case_id, cp, case when cp<=7 then 'Element-1' when cp<=16 then 'Element-2' when cp<=28 then 'Element-3' else 'Element-4' end as element, (cp*{mult}+k*3)%n as section_no "
            f"from (select case_id, count(*) as n from sec group by case_id), (select unnest(range(1,42)) as cp), (select unnest(range(0,3)) as k) where k<=cp%3)")


@register("j13_citation_totals", "", "with " + SEC + ", " + cite_sql() + """, p as (select case_id, section_no, count(*) as times from cite group by all), b as (select case_id, section_no, strlen(text) as bytes from sec)
select case_id, count(*) as unique_sections, cast(sum(times) as bigint) as citation_instances, cast(sum(bytes) as bigint) as unique_bytes, cast(sum(bytes*times) as bigint) as dup_bytes, round(sum(bytes*times)/sum(bytes),6) as dedupe_ratio from p join b using (case_id, section_no) group by case_id""")
def _(t):
    s = D.split_sections(policy_parts(t))
    return R6(D.citation_totals(citations(t, s), s), "dedupe_ratio")


@register("j13_element_bundles", "", "with " + SEC + ", " + cite_sql() + """, o as (select distinct case_id, element, section_no from cite)
select case_id, element, md5(string_agg('### '||section||chr(10)||text, chr(10) order by section_no)) as bundle_md5 from o join sec using (case_id, section_no) group by all""")
def _(t):
    s = D.split_sections(policy_parts(t))
    return D.element_bundles(citations(t, s), s).select("case_id", "element", F.md5("bundle").alias("bundle_md5"))


@register("r08_citation_overlap", "", "with " + SEC + ", " + cite_sql() + ", " + cite_sql(5, "cite2") + """, a as (select distinct case_id, cp, section_no from cite), b as (select distinct case_id, cp, section_no from cite2)
select case_id, cast(cp as int) as cp, count(*) filter (ia and ib) as shared, round(count(*) filter (ia and ib)/count(*) filter (ia),6) as recall, round(count(*) filter (ia and ib)/count(*),6) as jaccard
from (select coalesce(a.case_id,b.case_id) as case_id, coalesce(a.cp,b.cp) as cp, a.cp is not null as ia, b.cp is not null as ib from a full join b on a.case_id=b.case_id and a.cp=b.cp and a.section_no=b.section_no) group by all""")
def _(t):
    s = D.split_sections(policy_parts(t))
    return R6(D.citation_overlap(citations(t, s), citations(t, s, 5), ["case_id", "cp"], "section_no"), "recall", "jaccard")


STOP = "[" + ",".join(f"'{w}'" for w in D.STOP_WORDS) + "]"


@register("f15_tokens", "", f"""
with k as (select doc_id, text, list_transform(regexp_extract_all(text,'[a-zA-Z0-9]+'), lambda x: lower(x)) as tk, regexp_extract_all(text, '[''"]([^''"]{{6,}})[''"]', 1) as q from documents)
select doc_id, len(tk) as n_tokens, len(list_filter(list_distinct(tk), lambda x: not list_contains({STOP}, x))) as n_content,
 coalesce(md5(list_reduce(q, lambda a, b: case when length(b)>length(a) then b else a end, '')), md5('')) as quote_md5, len(regexp_extract_all(text,'(?i)Track\\s+(\\d+)')) as track_mentions from k""")
def _(t):
    x = c("text")
    return t.table("documents").select("doc_id", F.size(D.tokens(x)).cast("bigint").alias("n_tokens"), F.size(D.content_tokens(x)).cast("bigint").alias("n_content"),
                                       F.md5(D.longest_quote(x)).alias("quote_md5"), F.regexp_count(x, F.lit(r"(?i)Track\s+(\d+)")).cast("bigint").alias("track_mentions"))


@register("f16_query_text", "", """
with w as (select doc_id, source, list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(text, chr(10)), lambda l: not starts_with(l,'#')), ' '), '\\s+'), lambda x: x<>'') as w from documents)
select doc_id, md5(trim('Checking point '||source||' '||array_to_string(w[1:50], ' '))) as query_md5 from w""")
def _(t):
    return t.table("documents").select("doc_id", F.md5(D.query_text(F.concat(F.lit("Checking point "), c("source")), c("text"))).alias("query_md5"))
