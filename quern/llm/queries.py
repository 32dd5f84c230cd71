"""The queries of the training-data operators, p1 to p10 without p7, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, clusters, leak, neighbours, quality, setcodes, together, topn
from quern.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _splits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(s, d, "train_split"), table(s, d, "val_split"), table(s, d, "test_split")


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return together.item_pairs(table(s, d, "train_split"), "user_id", "train_items", 8, 3.0).select("item_a", "item_b")


def p1_pairs(s: SparkSession, d: str) -> DataFrame:
    return together.item_pairs(table(s, d, "train_split"), "user_id", "train_items", 8).selectExpr("item_a", "item_b", "c", "round(lift, 6) as lift")


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(s, d, "cooc_cache"), "cooc_rows", "cooc_cols", "cooc_vals", 10).select("cooc_rows", "cooc_cols")


def p2_ranked(s: SparkSession, d: str) -> DataFrame:
    ranked = topn.top_n(table(s, d, "cooc_cache"), "cooc_rows", "cooc_cols", "cooc_vals", 10)
    return ranked.selectExpr("cooc_rows", "cooc_cols", "cast(cooc_vals as double) as cooc_vals", "cast(rank as bigint) as rk")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return setcodes.split_overlap(*_splits(s, d))


def p3_report(s: SparkSession, d: str) -> DataFrame:
    return setcodes.split_overlap_report(*_splits(s, d))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(s, d, "item_features"))


def p4_neighbours(s: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(s, d, "item_features"), k=10).selectExpr("modality", "item_id", "neighbour", "round(similarity, 3) as similarity", "cast(rank as bigint) as rank")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return setcodes.similar_users(table(s, d, "train_split"))


def p5_links(s: SparkSession, d: str) -> DataFrame:
    return setcodes.user_links(table(s, d, "train_split"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return clusters.found_clusters(table(s, d, "item_features"))


def p6_described(s: SparkSession, d: str) -> DataFrame:
    return clusters.described_clusters(table(s, d, "item_features"))


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(s, d, "documents"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(s, d, "documents"), table(s, d, "eval_passages"))


def p9_report(s: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(table(s, d, "documents"), table(s, d, "eval_passages"))


def p9_edited(s: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(s, d, "documents"), table(s, d, "eval_passages"), edits=1)


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return quality.junk_documents(table(s, d, "documents"), table(s, d, "common_words"))


def p10_statistics(s: SparkSession, d: str) -> DataFrame:
    shares = ["mean_word_length", "symbol_share", "line_end_share", "common_share"]
    stats = quality.document_statistics(table(s, d, "documents"), table(s, d, "common_words"))
    return stats.selectExpr("doc_id", "n_words", "n_lines", *[f"round({c}, 6) as {c}" for c in shares])


def p10_scores(s: SparkSession, d: str) -> DataFrame:
    return quality.scored_documents(table(s, d, "documents"), table(s, d, "common_words")).select("doc_id", "p_junk", "n_votes")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_ranked, p3_found, p3_report, p4_found, p4_neighbours, p5_found, p5_links, p6_found, p6_described, p8_ids, p9_found, p9_report, p9_edited, p10_found, p10_statistics, p10_scores)}


def _sets(name: str, key: str, items: str, source: str) -> str:
    return (
        f"{name}_e as (select distinct {key} k, i from (select {key}, unnest({items}) i from {source}) where i is not null and {key} is not null), "
        f"{name}_n as (select k, count(*) n from {name}_e group by k)"
    )


_TRAIN = _sets("t", "user_id", "train_items", "train_split")
_PAIRS = (
    f"with {_TRAIN}, f as (select i, count(*) f from t_e group by i), total as (select count(*) n from t_n), "
    "c as (select a.i x, b.i y, count(*) c from t_e a join t_e b on a.k = b.k and a.i < b.i group by a.i, b.i having count(*) >= 8), "
    "l as (select x, y, c, c * n / (fa.f * fb.f) lift, c * n >= 3 * fa.f * fb.f high from c join f fa on x = fa.i join f fb on y = fb.i cross join total) "
)
_EDGES = (
    "with e as (select cooc_rows, cooc_cols, max(cooc_vals) v from cooc_cache where cooc_vals is not null and not isnan(cooc_vals) and cooc_rows <> cooc_cols group by 1, 2), "
    "r as (select *, row_number() over (partition by cooc_rows order by v desc, cooc_cols) rk from e) "
)
_EVAL = (
    f"{_sets('v', 'eval_id', 'val_set', 'val_split')}, {_sets('s', 'eval_id', 'test_set', 'test_split')}, "
    "e as (select 'val' sp, k, i from v_e union all select 'test', k, i from s_e), en as (select 'val' sp, k, n from v_n union all select 'test', k, n from s_n), "
    "o as (select e.sp, e.k ek, t_e.k tk, count(*) c from e join t_e on e.i = t_e.i group by 1, 2, 3), "
    "hit as (select o.sp split_name, ek eval_id, tk user_id from o join en on en.sp = o.sp and en.k = ek join t_n on t_n.k = tk where en.n >= 5 and t_n.n >= 5 and 4 * c >= 3 * (en.n + t_n.n - c))"
)
_USERS = (
    f"with {_TRAIN}, o as (select a.k x, b.k y, count(*) c from t_e a join t_e b on a.i = b.i and a.k < b.k group by 1, 2), "
    "hit as (select x user_a, y user_b from o join t_n p on p.k = x join t_n q on q.k = y where p.n >= 5 and q.n >= 5 and 10 * c >= 7 * (p.n + q.n - c)) "
)


def _vectors(modality: str, column: str, dim: int) -> str:
    return (
        f"select distinct '{modality}' modality, item_id, list_transform({column}, lambda x: cast(x as double)) v from item_features where len({column}) = {dim} "
        f"and len(list_filter({column}, lambda x: x is null or isnan(x))) = 0 and len(list_filter({column}, lambda x: x <> 0)) > 0"
    )


_NEAR = (
    f"with f as ({_vectors('image', 'image_feat', 96)} union all {_vectors('text', 'text_feat', 64)}), "
    "s as (select a.modality, a.item_id a, b.item_id b, round(list_cosine_similarity(a.v, b.v), 9) sim from f a join f b on a.modality = b.modality and a.item_id <> b.item_id), "
    "g as (select * from s where sim >= 0.8) "
)
_CLUSTERS = (
    _NEAR + ", own as (select modality, a, least(a, min(b)) l, count(*) + 1 deg from g group by 1, 2), size as (select modality, l, count(*) n, min(deg) lo, max(deg) hi from own group by 1, 2), "
    "clean as (select modality, l, n from size where lo = n and hi = n)"
)

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_WINDOWS = (
    r"with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null), "
    r"p as (select passage_id, suite, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') w from eval_passages where passage is not null), "
    "dw as (select distinct doc_id, array_to_string(list_slice(w, i, i + 19), ' ') g from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)), "
    "pw as (select distinct passage_id, suite, array_to_string(list_slice(w, i, i + 19), ' ') g from (select passage_id, suite, w, unnest(range(1, len(w) - 18)) i from p where len(w) >= 20)), "
    "hit as (select distinct doc_id, passage_id, suite from dw join pw using (g)) "
)
_STATS = (
    f"with d as (select doc_id, coalesce(text, '') t, {_WORDS} w from documents), "
    r"l as (select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') l from d), "
    "c as (select list(word) cw from common_words), "
    "s as (select d.doc_id, len(w) n_words, len(l) n_lines, list_sum(list_transform(w, lambda x: length(x))) / nullif(cast(len(w) as double), 0) mean_word_length, "
    r"length(regexp_replace(t, '[\p{L}\p{N}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g')) / nullif(cast(length(t) as double), 0) symbol_share, "
    "len(list_filter(l, lambda x: contains('.!?;:', right(x, 1)))) / nullif(cast(len(l) as double), 0) line_end_share, "
    "len(list_filter(w, lambda x: list_contains(cw, x))) / nullif(cast(len(w) as double), 0) common_share from d join l using (doc_id) cross join c) "
)
_SHARES = ", ".join(f"round({c}, 6) {c}" for c in ("mean_word_length", "symbol_share", "line_end_share", "common_share"))

SQL: dict[str, str] = {
    "p1_found": _PAIRS + "select x item_a, y item_b from l where high",
    "p1_pairs": _PAIRS + "select x item_a, y item_b, c, round(lift, 6) lift from l",
    "p2_found": _EDGES + "select cooc_rows, cooc_cols from r where rk <= 10",
    "p2_ranked": _EDGES + "select cooc_rows, cooc_cols, cast(v as double) cooc_vals, rk from r where rk <= 10",
    "p3_found": f"with {_TRAIN}, {_EVAL} select split_name, eval_id, user_id from hit",
    "p3_report": f"with {_TRAIN}, {_EVAL}, src as (select 'val' sp, eval_id k, coalesce(min(source), 'unknown') source from val_split group by 2 union all select 'test', eval_id, coalesce(min(source), 'unknown') from test_split group by 2) "
    "select en.sp split_name, source, count(*) n_records, count(h.eval_id) n_overlapping from en join src on src.sp = en.sp and src.k = en.k "
    "left join (select distinct split_name, eval_id from hit) h on h.split_name = en.sp and h.eval_id = en.k where n >= 5 group by 1, 2",
    "p4_found": _NEAR + ", r as (select *, row_number() over (partition by modality, a order by sim desc, b) rk from g) select distinct modality, least(a, b) item_a, greatest(a, b) item_b from r where rk <= 5",
    "p4_neighbours": _NEAR + ", r as (select *, row_number() over (partition by modality, a order by sim desc, b) rk from g) select modality, a item_id, b neighbour, round(sim, 3) similarity, rk as rank from r where rk <= 10",
    "p5_found": _USERS + "select user_a, user_b from hit",
    "p5_links": _USERS + ", m as (select k, list_sort(list(i)) s from t_e group by k having count(*) >= 5), k as (select k, min(k) over (partition by s) cls from m), "
    "both_ as (select user_a u from hit union all select user_b from hit) select k user_id, cls class_id, count(u) n_links from k left join both_ on u = k group by 1, 2",
    "p6_found": _CLUSTERS + " select modality, l cluster_id, a item_id from own join clean using (modality, l)",
    "p9_found": _WINDOWS + "select doc_id, passage_id from hit",
    "p9_report": _WINDOWS + "select passage_id, suite, count(*) n_docs from hit group by 1, 2",
    "p10_found": _STATS + "select doc_id from s where n_words > 0 and (common_share < 0.2)::int + (line_end_share < 0.3)::int + (symbol_share > 0.1)::int + (mean_word_length < 3.6 or mean_word_length > 7.5)::int + (n_words < 30)::int >= 2",
    "p10_statistics": _STATS + f"select doc_id, n_words, n_lines, {_SHARES} from s",
}
