"""SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from ..operators.neighbors import BAD_WORD
from .queries import STOP

_SEEDS = "('for', 'that', 'was')"
_DIMS = "unnest(range(1, 65))"
_BAD = BAD_WORD.replace("(?U)", "")

_TOK = "tok as (select doc_id, cast(n_chars as double) y, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') k from documents where n_chars is not null)"
_FLAT = "flat as (select doc_id, unnest(k) w, unnest(range(len(k))) i from tok)"
_CNT = "cnt as (select w, count(*) n from flat group by w), tot as (select sum(n) t from cnt)"
_KV = """kv as (
  select r.w word, r.r rank, list_transform(e.embedding, lambda x: cast(cast(x as float) * (1 + r.r % 3) as float)::double) v
  from (select w, row_number() over (order by n desc, w) - 1 r from cnt) r join embeddings e on e.vec_id = r.r),
kvu as (select word, rank, v, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) u from kv)"""
_DIR = "dir as (select embedding::double[] d, list_transform(embedding::double[], lambda x: x / greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])), 1e-12)) du from embeddings where vec_id = 0)"
_OCC = f"""pairs as (select a.doc_id, a.i, b.w from flat a join flat b on a.doc_id = b.doc_id and b.i between a.i - 3 and a.i + 3 and a.i <> b.i where a.w in {_SEEDS}),
wt as (select word, v, u, 1e-3 / (1e-3 + coalesce(n / t, 0)) a from kvu left join cnt on cnt.w = word cross join tot)"""
_OV = f"ov as (select doc_id, i, dim, sum(a * v[dim]) / sum(a) x from (select p.doc_id, p.i, wt.a, wt.v, {_DIMS} dim from pairs p join wt on wt.word = p.w) group by all)"
_DV = "dv as (select doc_id, dim, avg(x) x from ov group by all), vec as (select doc_id, list(x order by dim) v from dv group by doc_id)"
_BASE = ", ".join((_TOK, _FLAT, _CNT))
_VEC = ", ".join((_BASE, _KV, _OCC, _OV, _DV))


def _measures(source: str, missing: bool = False) -> str:
    """Totals of a corpus ``c(doc_id, y, k)``, each with its bin b."""
    return f"""{source},
st as (select count(*) n, avg(y) m, stddev_pop(y) sd, count(*) filter (where y is null) nulls, list_distinct(quantile_cont(y, [0, 0.25, 0.5, 0.75, 1])) e from c),
bin as (select doc_id, y, k, case when len(e) > 1 and y is not null then greatest(len(list_filter(e, lambda x: x < y)) - 1, 0) end b from c cross join st),
sizes as (select b, count(*) nb from bin group by b)"""


_C = f"{_TOK}, c as (select doc_id, y, k from tok)"
_CQ = "c as (select d.doc_id, cast(l.quality as double) y, regexp_extract_all(lower(coalesce(d.text, '')), '\\p{L}+') k from documents d join labels l on l.doc_id = d.doc_id and l.quality is not null)"
_CALL = "c as (select d.doc_id, cast(l.quality as double) y, regexp_extract_all(lower(coalesce(d.text, '')), '\\p{L}+') k from documents d left join labels l using (doc_id))"
_STATS = """per as (select token, b, count(*) k, sum(y - m) s from (select b, y, unnest(list_distinct(k)) token from bin) cross join st group by all),
agg as (select token, sum(k) docs, sum(s) s from per group by token),
ws as (select token, b, nb, coalesce(k, 0) k from (select token from agg) cross join sizes left join per using (token, b)),
cov as (select token, (sum(case when b is null then 0 else k / nb end)) / count(*) bal, bool_or(b is null) gap, arg_min(k / nb, b) first, arg_max(k / nb, b) last from ws group by token),
out as (
  select token, cast(docs as bigint) docs, docs / n cov_all, bal cov_bal,
    case when docs = n then 0.0 when nulls > 0 or sd <= 0 then null else s / n / (sqrt(docs / n * (1 - docs / n)) * sd) end corr,
    case when gap then 0.0 else first end q1, case when gap then 0.0 else last end q4
  from agg join cov using (token) cross join st),
ranked as (select *, cov_bal * (1 - least(1.0, coalesce(abs(corr) / 0.3, 1.0))) rank from out)"""


def _suggest(source: str) -> str:
    return f"""with {_measures(source)}, {_STATS}
select token, docs, round(cov_all, 6) cov_all, round(cov_bal, 6) cov_bal, round(corr, 6) corr, round(rank, 6) rank
from ranked where docs >= 5 order by ranked.rank desc, ranked.cov_bal desc, docs desc, token limit 150"""


def _presence(source: str) -> str:
    return f"""with {_measures(source)}, {_STATS}
select token, docs, round(cov_all, 6) cov_all, round(cov_bal, 6) cov_bal, round(corr, 6) corr, round(rank, 6) rank, round(q1, 6) q1, round(q4, 6) q4
from ranked where token = 'that'"""


_PRE = """raw as (select doc_id, coalesce(text, '') text from documents),
parts as (select doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') p from raw),
sent as (select doc_id, text, p, unnest(p) sentence, unnest(range(len(p))) s from parts),
lem as (
  select doc_id, s, sentence, list_filter(regexp_extract_all(lower(regexp_replace(sentence, 'https?://\\S+|(^|\\s)@\\S+', ' ', 'g')), '[\\p{L}\\p{N}]+'),
    lambda x: not regexp_full_match(x, '\\p{Nd}+')) l from sent)"""
_TOKS = """tk as (select doc_id, s, unnest(l) w, unnest(range(len(l))) j from lem),
flat as (select doc_id, s, w, row_number() over (partition by doc_id order by s, j) - 1 i from tk)"""
_WORDS = f"{_TOK}, wflat as (select doc_id, unnest(k) w from tok), wcnt as (select w, count(*) n from wflat group by w)"
_SNIP = f"""{_PRE}, {_TOKS}, {_CNT}, {_WORDS},
{_KV.replace("from cnt)", "from wcnt)")}, {_DIR}, {_OCC},
ou as (select doc_id, i, list(x order by dim) x from (
  select doc_id, i, dim, sum(a * u[dim]) / sum(a) x from (select p.doc_id, p.i, wt.a, wt.u, {_DIMS} dim from pairs p join wt on wt.word = p.w) group by all) group by all),
sizes as (select doc_id, len(p) ns, array_to_string(p, ' ') surface, p from parts),
docl as (select doc_id, array_to_string(list(w order by i), ' ') lemmas, count(*) n from flat group by doc_id)"""
_ANCHOR = """place as (
  select b.*, f.w seed, f.s s, greatest(b.i - 3, 0) a, least(b.i + 3, n - 1) z, ns, surface, p, lemmas
  from best b join flat f on f.doc_id = b.doc_id and f.i = b.i join docl on docl.doc_id = b.doc_id join sizes on sizes.doc_id = b.doc_id),
edge as (select place.*, fa.s sa, fz.s sz from place join flat fa on fa.doc_id = place.doc_id and fa.i = a join flat fz on fz.doc_id = place.doc_id and fz.i = z),
cut as (select *, case when sa < s and s >= 1 then s - 1 else s end s0, case when not (sa = s and sz = s) and not (sa < s and s >= 1) and s + 1 < ns then s + 1 else s end s1 from edge)"""
_OUT = """doc_id, round(cosine, 5) cosine, seed, cast(a as integer) start_token_idx, cast(z as integer) end_token_idx,
  cast(s0 as integer) start_sent_idx, cast(s1 as integer) end_sent_idx, trim(array_to_string(p[s0 + 1 : s1 + 1], ' '), ' ') snippet_anchor, surface essay_text_surface, lemmas essay_text_lemmas from cut"""
_BETA_COS = "bc as (select doc_id, i, list_inner_product(x, du) / greatest(sqrt(list_inner_product(x, x)), 1e-12) c from ou cross join dir)"


def _near(sign: str, n: int, restrict: int = 10_000) -> str:
    return f"""(select word, rank, u, c cos from (select word, rank, u, {sign}list_inner_product(u, du) c from kvu cross join dir where rank < {restrict} order by c desc, rank limit 2000)
  where not regexp_matches(word, '{_BAD}') order by c desc, rank limit {n})"""


_KVD = ", ".join((_BASE, _KV, _DIR))


def _clusters(side: str) -> str:
    sign, order = ("", "desc") if side == "pos" else ("-", "asc")
    return f"""pt_{side} as (select near.word, u, e.label from {_near(sign, 100, 50_000)} near join embeddings e on e.vec_id = near.rank),
ce_{side} as (
  select label, count, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) c from (
    select label, any_value(n) count, list(x order by dim) m from (
      select label, dim, avg(x) x, count(*) n from (select label, {_DIMS} dim, u from pt_{side}), lateral (select u[dim] x) group by all) group by label) where count >= 2),
cr_{side} as (select *, list_inner_product(c, du) cb, row_number() over (order by list_inner_product(c, du) {order}, label) r from ce_{side} cross join dir),
me_{side} as (select '{side}' side, r, word, list_inner_product(u, c) cc, list_inner_product(u, du) cb from pt_{side} join cr_{side} using (label)),
cl_{side} as (
  select '{side}' side, r.r cluster_rank, any_value(count) size, round(any_value(r.cb), 6) centroid_cos_beta, round(avg(cc), 6) coherence,
    array_to_string(list(word order by cc desc, word)[1:10], ', ') top_words
  from cr_{side} r join me_{side} m on m.r = r.r group by r.r)"""


ORACLE_SQL = {
    "token_counts": f"with {_BASE} select w token, n from cnt",
    "sif_weights": f"with {_BASE} select w token, n, round(1e-3 / (1e-3 + n / t), 9) a from cnt cross join tot",
    "document_frequency": f"with {_TOK} select token, count(*) docs from (select unnest(list_distinct(k)) token from tok) group by token",
    "quantile_bins": f"with {_measures(_C)} select doc_id, cast(b as integer) bin from bin",
    "quantile_bins_binary": f"with {_measures(_CQ)} select doc_id, cast(b as integer) bin from bin",
    "suggest_lexicon": _suggest(_C),
    "suggest_lexicon_binary": _suggest(_CQ),
    "token_presence": _presence(_C),
    "token_presence_missing": _presence(_CALL),
    "lexicon_summary": f"""with {_measures(_C.replace("select doc_id, y, k from tok", f"select doc_id, y, case when len(list_filter(k, lambda x: x in {_SEEDS})) > 0 then ['any'] else [] end k from tok"))}, {_STATS}
select docs docs_any, round(cov_all, 6) cov_all, round(q1, 6) q1, round(q4, 6) q4, round(corr, 6) corr_any from ranked where token = 'any'""",
    "lexicon_per_token": f"""with {_measures(_C.replace("select doc_id, y, k from tok", f"select doc_id, y, list_filter(k, lambda x: x in {_SEEDS}) k from tok"))}, {_STATS}
select word, coalesce(docs, 0) docs, coalesce(round(cov_all, 6), 0.0) cov_all, coalesce(round(q1, 6), 0.0) q1, coalesce(round(q4, 6), 0.0) q4, coalesce(round(corr, 6), 0.0) corr
from (select unnest(['for', 'that', 'was', 'qqqq']) word) left join ranked on token = word""",
    "sentence_split": f"""with {_PRE},
grown as (select doc_id, s, sentence, text, p, coalesce(list_sum(list_transform(p[:s], lambda x: length(x))), 0) before from sent),
gaps as (select *, regexp_extract_all(text, '[.!?][ \\t\\n\\r\\f\\v]+') g from grown)
select doc_id, cast(s as integer) s, sentence, cast(before + gap as integer) start, cast(before + gap + length(sentence) as integer) stop
from (select *, coalesce(list_sum(list_transform(g[:s], lambda x: length(x) - 1)), 0) gap from gaps)""",
    "token_keep": f"""with {_PRE} select doc_id, array_to_string(list_filter(flatten(list(l order by s)), lambda x: x not in ({", ".join(repr(w) for w in STOP)})), ' ') lemmas from lem group by doc_id""",
    "token_to_sentence": f"with {_PRE}, {_TOKS} select doc_id, cast(i as integer) i, w lemma, cast(s as integer) sent from flat",
    "url_token_keep": """with raw as (select page_id, concat_ws(' ', 'see', url, '@you 12 a1.', page_id) text from pages),
parts as (select page_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) s, generate_subscripts(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), 1) j from raw),
l as (select page_id, j, list_filter(regexp_extract_all(lower(regexp_replace(s, 'https?://\\S+|(^|\\s)@\\S+', ' ', 'g')), '[\\p{L}\\p{N}]+'), lambda x: not regexp_full_match(x, '\\p{Nd}+')) l from parts)
select page_id, array_to_string(flatten(list(l order by j)), ' ') lemmas from l group by page_id""",
    "seed_occurrences": f"with {_BASE} select doc_id, cast(i as integer) i, w seed from flat where w in {_SEEDS}",
    "context_pairs": f"with {_BASE}, {_KV}, {_OCC} select doc_id, cast(i as integer) i, w word, count(*) n from pairs group by all",
    "occurrence_vectors": f"with {_BASE}, {_KV}, {_OCC}, {_OV} select doc_id, cast(i as integer) i, cast(dim - 1 as integer) dim, round(x, 6) x from ov",
    "doc_vectors": f"with {_VEC} select doc_id, cast(dim - 1 as integer) dim, round(x, 6) x from dv",
    "doc_vectors_l2": f"with {_VEC} select dv.doc_id, cast(dim - 1 as integer) dim, round(x / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) x from dv join vec on vec.doc_id = dv.doc_id",
    "kept_mask": f"with {_VEC} select doc_id, doc_id in (select doc_id from vec) kept from tok",
    "neighbors_pos": f"with {_KVD} select word, round(cos, 6) cos from {_near('', 20)}",
    "neighbors_neg": f"with {_KVD} select word, round(cos, 6) cos from {_near('-', 20)}",
    "neighbors_shift": f"with {_KVD} select near.word, round(cos, 6) cos, round(-list_inner_product(kv.v, d), 6) shift from {_near('-', 16)} near join kv on kv.word = near.word cross join dir",
    "top_words": f"""with {_KVD}
select 'pos' side, cast(row_number() over (order by cos desc, rank) as integer) rank, word, round(cos, 6) cos from {_near('', 10)}
union all select 'neg', cast(row_number() over (order by cos desc, rank) as integer), word, round(cos, 6) from {_near('-', 10)}""",
    "doc_scores_fixed": f"""with {_VEC}, {_DIR}
select doc_id, round(list_inner_product(v, du) / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) cos_align, round(2.5 * list_inner_product(v, d), 6) score_std,
  round(1500 + 800 * 2.5 * list_inner_product(v, d), 6) yhat_raw from vec cross join dir""",
    "score_all_docs": f"""with {_VEC}, {_DIR}
select tok.doc_id, vec.doc_id is not null kept, round(list_inner_product(v, du) / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) cos, round(2.5 * list_inner_product(v, d), 6) yhat_std,
  round(1500 + 800 * 2.5 * list_inner_product(v, d), 6) yhat_raw, case when vec.doc_id is not null then round((y - 1500) / 800, 6) end y_true_std, case when vec.doc_id is not null then y end y_true_raw
from tok cross join dir left join vec on vec.doc_id = tok.doc_id""",
    "beta_snippets": f"""with {_SNIP}, {_BETA_COS},
best as ((select 'beta_pos' side_label, doc_id, i, c cosine from bc order by round(c, 9) desc, doc_id, i limit 200) union all (select 'beta_neg', doc_id, i, -c from bc order by round(-c, 9) desc, doc_id, i limit 200)), {_ANCHOR}
select side_label, {_OUT}""",
    "beta_snippets_floor": f"""with {_SNIP}, {_BETA_COS},
best as (select 'beta_pos' side_label, doc_id, i, c cosine from bc where c >= 0.2 union all select 'beta_neg', doc_id, i, -c from bc where -c >= 0.2), {_ANCHOR}
select side_label, {_OUT}""",
    "cluster_stats": f"with {_KVD}, {_clusters('pos')}, {_clusters('neg')} select side, cast(cluster_rank as integer) cluster_rank, size, centroid_cos_beta, coherence, top_words from (select * from cl_pos union all select * from cl_neg)",
    "cluster_members": f"with {_KVD}, {_clusters('pos')} select side, cast(r as integer) cluster_rank, word, round(cc, 6) cos_to_centroid, round(cb, 6) cos_to_beta from me_pos",
    "cluster_snippets": f"""with {_SNIP}, {_clusters('pos')},
sc as (select 'pos_cluster_' || r centroid_label, doc_id, i, list_inner_product(x, c) / greatest(sqrt(list_inner_product(x, x)), 1e-12) cosine from ou cross join cr_pos),
best as (select centroid_label, doc_id, i, cosine from sc qualify row_number() over (partition by centroid_label order by round(cosine, 9) desc, doc_id, i) <= 100), {_ANCHOR}
select centroid_label, {_OUT}""",
    "silhouette": f"""with {_KVD}, {_clusters('pos')},
dm as (select a.word, a.label la, b.label lb, avg(list_distance(a.u, b.u)) d from pt_pos a join pt_pos b on a.word <> b.word group by all),
ab as (select word, max(case when la = lb then d end) own, min(case when la <> lb then d end) next from dm group by word)
select round(avg(case when own is null or next is null then 0 else (next - own) / greatest(next, own) end), 6) silhouette from ab""",
    "fit_two_dims": f"""with {_VEC},
x as (select v[1] a, v[2] b, y from vec join tok on tok.doc_id = vec.doc_id),
m as (select count(*) n, avg(y) ym, stddev_pop(y) ys, var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab, covar_pop(a, y) / stddev_pop(y) ay, covar_pop(b, y) / stddev_pop(y) by_ from x),
f as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) b0, (by_ * aa - ay * ab) / (aa * bb - ab * ab) b1 from m),
g as (select *, b0 * ay + b1 * by_ r2, sqrt(b0 * b0 + b1 * b1) len from f),
q as (select quantile_cont((a * b0 + b * b1) / len / sqrt(a * a + b * b), 0.75) - quantile_cont((a * b0 + b * b1) / len / sqrt(a * a + b * b), 0.25) iqr from x cross join g)
select n n_kept, cast(2 as bigint) n_components, round(b0, 6) beta_0, round(b1, 6) beta_1, round(r2, 6) r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) r2_adj,
  round((r2 / 2) / ((1 - r2) / (n - 3)), 6) f_stat, round(len, 6) "beta_norm_stdCN", round(ym, 6) y_mean, round(ys, 6) y_std, round(sqrt(r2), 6) y_corr_pred,
  round(0.1 * len * ys, 6) delta_per_0p10_raw, round(iqr * len * ys, 6) iqr_effect_raw from g cross join q""",
}
