"""The derived test views in the reference SQL dialect, used only by the checks."""

from __future__ import annotations

_FLOW_WIDE = ", ".join(
    f"max(case when idx={i} then t end) as relative_time_{i}, max(case when idx={i} then length end) as packet_length_{i}"
    for i in range(5))

VIEWS: dict[str, tuple[list[str], str]] = {
    "f_pkt": ([], """
with o as (select user_id, ts, event_type, value, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events),
g as (select user_id, event_type, value, epoch_us(ts) as us, cast(floor(rn/5) as bigint) as flow_no, cast(rn%5 as int) as idx,
      least(3, cast(floor(value/25) as int)) as b from o),
h as (select *, count(*) over (partition by user_id, flow_no) as n, min(us) over (partition by user_id, flow_no) as us0 from g)
select user_id*1000000000+flow_no as flow_id, user_id, flow_no, idx, event_type,
  cast(case b when 0 then 47 when 1 then 120 when 2 then 650 else 1150 end
       + case when b>=2 then cast(floor(value*100) as bigint)%2 else 0 end as double) as length,
  cast(us-us0 as double)/1e13 as t
from h where n=5"""),
    "f_flow": (["f_pkt"], f"""
select flow_id, user_id, flow_no, {_FLOW_WIDE},
  cast((user_id%5)*2 + max(case when idx=0 and event_type in ('click','view') then 1 else 0 end) as int) as label_id,
  case when flow_no%5=4 then 'test' else 'train' end as split, cast(user_id%5 as int) as fold
from f_pkt group by flow_id, user_id, flow_no"""),
    "f_gap": (["f_flow"], """
select flow_id, label_id, i as gap_index,
  case i when 1 then relative_time_1-relative_time_0 when 2 then relative_time_2-relative_time_1
         when 3 then relative_time_3-relative_time_2 else relative_time_4-relative_time_3 end as iat
from f_flow, (select unnest(range(1,5)) as i)"""),
    "f_key": (["f_flow"], """
select *, packet_length_0||'-'||packet_length_1||'-'||packet_length_2||'-'||packet_length_3||'-'||packet_length_4 as lkey from f_flow"""),
    "f_group": (["f_flow"], """
select *, concat_ws('-', cast(round_even(packet_length_0/8,0)*8 as bigint), cast(round_even(packet_length_1/8,0)*8 as bigint),
  cast(round_even(packet_length_2/8,0)*8 as bigint), cast(round_even(packet_length_3/8,0)*8 as bigint), cast(round_even(packet_length_4/8,0)*8 as bigint))
  || '|' || cast(cast(round_even(log10(greatest(relative_time_4,1e-9))*10,0) as bigint) as varchar) as gkey from f_flow"""),
    "f_prob": (["f_flow"], """
with w as (select f.flow_id as row_id, f.label_id as y, f.fold, m.model, k.k,
   1.0 + (f.flow_id*m.a + k.k*m.c)%17 + case when k.k=f.label_id then m.boost else 0 end as w
  from f_flow f cross join (select 'a' as model, 7 as a, 13 as c, 11 as boost union all select 'b',5,11,9 union all select 'c',3,19,14) m
  cross join (select distinct cast(event_id as int) as k from events where event_id<10) k)
select row_id, y, fold, model, k, cast(w as double)/sum(cast(w as double)) over (partition by row_id, model) as p from w"""),
    "f_pred_label": (["f_prob"], """
select row_id, y, fold, model, arg_max(k, (p, -k)) as pred, max(p) as conf, max(case when k=y then p end) as p_true
from f_prob group by row_id, y, fold, model"""),
    "f_gt": ([], """
select image_id, box_id, l_partkey as pk, l_suppkey as sk, l_quantity as q, x1, y1, x1+4+l_quantity as x2, y1+6+(l_partkey%40) as y2 from (
 select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) as box_id,
  l_partkey, l_suppkey, l_quantity, cast((l_partkey*37)%400 as double) as x1, cast((l_suppkey*53)%300 as double) as y1 from lineitem) z"""),
    "f_pred": (["f_gt"], """
select image_id, box_id*2 as cand_id, cast(sk%3 as int) as source, x1+(sk%7)-3 as x1, y1+(pk%5)-2 as y1, x2+(pk%9)-4 as x2, y2+(sk%5)-2 as y2,
  cast(1+(pk*31+sk*17+box_id*7)%97 as double)/100 as score from f_gt where pk%10<>0
union all
select image_id, box_id*2+1, cast(pk%3 as int), cast((pk*91)%400 as double), cast((sk*29)%300 as double), cast((pk*91)%400+5 as double)+q, cast((sk*29)%300+9 as double),
  cast(1+(pk*13+sk*5+box_id*11)%60 as double)/100 from f_gt where pk%6=0"""),
    "f_iou": (["f_gt", "f_pred"], """
select image_id, cand_id, box_id, source, score,
  case when ap+ag-inter > 0 then inter/greatest(ap+ag-inter,1e-9) else 0 end as iou
from (select p.image_id, p.cand_id, p.source, p.score, g.box_id,
   greatest(least(p.x2,g.x2)-greatest(p.x1,g.x1),0)*greatest(least(p.y2,g.y2)-greatest(p.y1,g.y1),0) as inter,
   (p.x2-p.x1)*(p.y2-p.y1) as ap, (g.x2-g.x1)*(g.y2-g.y1) as ag
  from f_pred p join f_gt g on p.image_id=g.image_id) z where inter > 0"""),
    "f_match": (["f_iou"], """
select image_id, cand_id, score, hit is not null as tp from (
with recursive ce as (select image_id, cand_id, list({'b': box_id, 'i': iou} order by iou desc, box_id) as el from f_iou where iou>=0.5 group by image_id, cand_id),
c2 as (select p.image_id, p.cand_id, p.score, row_number() over (partition by p.image_id order by p.score desc, p.cand_id) as rk, coalesce(el, []) as el from f_pred p left join ce using (image_id, cand_id)),
rec as (select distinct image_id, cast(0 as bigint) as rk, cast(null as bigint) as cand_id, cast(null as double) as score, cast(null as bigint) as hit, cast([] as bigint[]) as used from f_pred
 union all
 select image_id, rk, cand_id, score, hit, case when hit is null then used else list_append(used, hit) end from (
  select r.image_id, c2.rk, c2.cand_id, c2.score, list_filter(c2.el, lambda s: not list_contains(r.used, s.b))[1].b as hit, r.used from rec r join c2 on c2.image_id=r.image_id and c2.rk=r.rk+1) z)
select * from rec where rk>0) y"""),
    "f_raster": (["f_gt"], """
select i.image_id, yy.v as y, xx.v as x, cast((xx.v*7+yy.v*11+i.image_id)%9 as double) as t_ink,
  cast((xx.v*7+yy.v*11+i.image_id)%9 as double) + case when (floor(xx.v/6)+floor(yy.v/5)+i.image_id)%7=0 then 40 else 0 end as p_ink
from (select distinct image_id from f_gt) i cross join (select cast(event_id as int) as v from events where event_id<12) xx
 cross join (select cast(event_id as int) as v from events where event_id<12) yy"""),
    "f_rbox": (["f_gt"], """
select image_id, box_id, x1 % 9 as x1, y1 % 9 as y1, x1 % 9 + least(x2-x1, 3) as x2, y1 % 9 + least(y2-y1, 3) as y2
from f_gt"""),
    "f_grid": (["f_raster"], """
select image_id, y, x, ((x*37 + y*91 + image_id) % 101) / 100.0 as score, cast(4 + x % 9 as double) as w, cast(4 + y % 7 as double) as h from f_raster"""),
    "f_verdict": ([], """
select case_id, cp, element, gold, case when (case_id+cp*7+toxic)%9=0 then (case gold when '1' then '0' else '1' end) when gold='N/A' then '0' else gold end as pred,
  case when (case_id*5+cp)%4=0 then (case gold when '1' then '0' else '1' end) else gold end as vote2,
  case when (case_id*3+cp)%5=0 then (case gold when '0' then 'N/A' else '0' end) else gold end as vote3,
  cast((case_id*7+cp*3)%40+60 as double)/100 as confidence
from (select l.doc_id as case_id, c.cp, l.toxic,
  case when c.cp<=7 then 'Element-1' when c.cp<=16 then 'Element-2' when c.cp<=28 then 'Element-3' else 'Element-4' end as element,
  case (l.doc_id*3+c.cp*5+l.quality)%11 when 0 then 'N/A' when 1 then '0' when 2 then '0' else '1' end as gold
  from labels l cross join (select cast(event_id+1 as int) as cp from events where event_id<41) c) z"""),
    "f_ledger": ([], """
select conv_id as case_id, turn, 'model_' || cast(conv_id%3 as varchar) as model, length(text) as completion_tokens, coalesce(lag(length(text)) over (partition by conv_id order by turn),0)+200 as prompt_tokens,
  case when length(text)>900 then 'length' else 'stop' end as finish_reason,
  case when turn%4=3 then 'Sure. [{"cp":"CP' || cast(turn as varchar) || '","verdict":"1",},]' when turn%4=1 then '```json [{"cp":"CP' || cast(turn as varchar) || '","verdict":"N/A"}] ```' else 'no json' end as response
from conversations where role='assistant'"""),
    "f_search": ([], """
select p_partkey as seq, cast(p_partkey%700 as bigint) as hash, case p_size%5 when 0 then 'gbt' when 1 then 'rf' when 2 then 'logreg' when 3 then 'knn' else 'mlp' end as model,
  case when p_partkey%3=0 then 'full' when p_partkey%3=1 then 'top120' else 'top60' end as features, p_partkey%2=0 as target_feats,
  cast((p_partkey*37)%300 as double)/1000+0.55 as group_acc, cast(p_retailprice as double)/10 as fit_seconds from part"""),
    "f_doc": ([], """
select doc_id, source as case_id, lang, cast(1 + doc_id % 9 as int) as track, text || case when doc_id%6=0 then ' [DEFICIENCY - NOT DOCUMENTED]' else '' end
  || case when doc_id%11=0 then ' records kept in Vietnamese' else '' end as text, n_chars
from documents where not (source in ('src7','src17') and doc_id % 9 = 0)"""),
    "f_label": ([], """
select cast(i as int) as label_id, (['Discord','GoogleMeet','Messenger','WhatsApp','Zoom'])[i//2+1] as app, (['voice','video'])[i%2+1] as mode,
  (['Discord','GoogleMeet','Messenger','WhatsApp','Zoom'])[i//2+1] || '_' || (['voice','video'])[i%2+1] as label
from (select unnest(range(10)) as i)"""),
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named views and what they need; body may go on with ``, x as (...)``."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in VIEWS[name][0]:
            visit(need)
        done.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not done:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in done)
    return f"with recursive {ctes}\n{body}"
