"""The queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- shared parts

EMB = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'M' || label AS model, 'G' || (label // 2) AS grp FROM embeddings),
pairs AS (SELECT q.vec_id AS q_id, q.label AS q_label, q.model AS q_model, q.grp AS q_grp, r.vec_id AS ref_id, r.model, r.grp, round(list_cosine_similarity(q.v, r.v), 9) AS sim
          FROM e q JOIN e r ON r.label < 8 AND r.vec_id <> q.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, ref_id) AS rank FROM pairs) WHERE rank <= 10)
"""

VOTE = EMB + """,
w AS (SELECT *, greatest(sim, 0) AS w FROM nn),
gv AS (SELECT q_id, grp, round(sum(w), 9) AS gv, min(rank) AS gr FROM w GROUP BY q_id, grp),
mv AS (SELECT q_id, grp, model, round(sum(w), 9) AS mv, min(rank) AS mr FROM w GROUP BY q_id, grp, model),
tot AS (SELECT q_id, any_value(q_label) AS q_label, any_value(q_model) AS q_model, any_value(q_grp) AS q_grp, round(sum(w), 9) AS total, max(sim) AS top1 FROM w GROUP BY q_id),
best AS (SELECT m.*, g.gv, row_number() OVER (PARTITION BY m.q_id ORDER BY gv DESC, gr, mv DESC, mr) AS n FROM mv m JOIN gv g ON m.q_id = g.q_id AND m.grp = g.grp),
match AS (SELECT t.q_id, q_label, q_model, q_grp, CASE WHEN top1 >= 0.35 THEN b.model ELSE '未知型号' END AS model, CASE WHEN top1 >= 0.35 THEN b.grp END AS cavity_group,
                 CASE WHEN top1 >= 0.35 AND total > 0 THEN b.gv / total ELSE 0.0 END AS confidence, top1 AS top1_sim
          FROM tot t JOIN best b ON t.q_id = b.q_id AND b.n = 1)
"""

FACTS = VOTE + """,
facts AS (SELECT q_id, q_model AS true_model, model AS matched, q_label >= 8 AS external, q_label < 8 AS inside, coalesce(cavity_group = q_grp, false) AS correct, cavity_group IS NULL AS rejected, top1_sim FROM match)
"""

PROFILE = """
profile AS (SELECT p_brand AS name, 1 + no % 8 AS rack_count, no % 2 = 0 AS floor_usable, 'G' || (no % 5) AS cavity_group,
                   CASE no % 3 WHEN 1 THEN ['tray'] WHEN 2 THEN ['tray', 'grill'] END AS accessories
            FROM (SELECT DISTINCT p_brand, regexp_replace(p_brand, '[^0-9]', '', 'g')::INT AS no FROM part) WHERE no % 7 <> 0)
"""

LABELS = PROFILE + """,
labels_ AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag <> 'R' AS is_oven,
    CASE WHEN l_returnflag = 'R' AND l_linenumber <> 7 THEN NULL WHEN p_size % 10 = 0 THEN '未知' WHEN p_size % 13 = 0 THEN NULL ELSE p_brand END AS device_model,
    CASE WHEN l_tax < 0.07 THEN l_discount >= 0.05 END AS food_exist,
    CASE WHEN l_linenumber <> 6 THEN list_filter([CASE WHEN l_partkey % 2 = 0 THEN 'glass' END, CASE WHEN l_suppkey % 3 = 0 THEN 'metal' END, CASE WHEN l_orderkey % 5 = 0 THEN 'foil' END], lambda x: x IS NOT NULL) END AS container,
    CASE WHEN l_linenumber <> 5 THEN list_filter([CASE WHEN l_partkey % 3 = 0 THEN 'tray' END, CASE WHEN l_suppkey % 4 = 0 THEN 'grill' END, CASE WHEN l_orderkey % 7 = 0 THEN 'spit' END], lambda x: x IS NOT NULL) END AS accessory,
    CASE WHEN l_quantity >= 10 THEN l_linenumber - 1 END AS rack_level
  FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (SELECT l.*, p.rack_count, p.floor_usable, p.cavity_group, p.accessories AS supported, p.name IS NOT NULL AS in_profile,
             coalesce(l.device_model IN ('未知', '未知型号'), false) AS ext,
             coalesce(food_exist, false) OR coalesce(len(container) > 0, false) OR coalesce(len(accessory) > 0, false) AS has_item,
             food_exist IS NOT NULL AND container IS NOT NULL AND accessory IS NOT NULL AS items_known
      FROM labels_ l LEFT JOIN profile p ON l.device_model = p.name)
"""

ISSUES = LABELS + """,
log AS (
  SELECT l_orderkey, l_linenumber, device_model, 'error' AS level, 'missing_device' AS code FROM j WHERE is_oven AND device_model IS NULL
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'error', 'unknown_device' FROM j WHERE is_oven AND NOT ext AND device_model IS NOT NULL AND NOT in_profile
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'error', 'rack_out_of_range' FROM j WHERE is_oven AND NOT ext AND in_profile AND rack_level > rack_count
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'error', 'rack_floor_unusable' FROM j WHERE is_oven AND NOT ext AND in_profile AND rack_level = 0 AND NOT floor_usable
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'warning', 'accessory_unsupported' FROM j WHERE is_oven AND NOT ext AND in_profile AND supported IS NOT NULL AND len(list_filter(accessory, lambda a: NOT list_contains(supported, a))) > 0
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'warning', 'rack_without_accessory' FROM j WHERE is_oven AND NOT ext AND rack_level >= 1 AND len(accessory) = 0
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'warning', 'rack_missing' FROM j WHERE is_oven AND NOT ext AND rack_level IS NULL AND has_item
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'warning', 'rack_on_empty' FROM j WHERE is_oven AND NOT ext AND rack_level IS NOT NULL AND items_known AND NOT has_item
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'error', 'device_not_oven' FROM j WHERE NOT is_oven AND device_model IS NOT NULL
  UNION ALL SELECT l_orderkey, l_linenumber, device_model, 'warning', 'rack_not_oven' FROM j WHERE NOT is_oven AND rack_level IS NOT NULL)
"""

ENCODED = LABELS + """,
g AS (SELECT cavity_group, (row_number() OVER (ORDER BY cavity_group) - 1)::INT AS gid FROM (SELECT DISTINCT cavity_group FROM profile)),
enc AS (SELECT j.*, is_oven AND NOT ext AND device_model IS NOT NULL AND in_profile AS device_known,
               CASE WHEN ext AND is_oven THEN -2 WHEN is_oven AND NOT ext AND device_model IS NOT NULL AND in_profile THEN gid ELSE -1 END AS group_id
        FROM j LEFT JOIN g ON j.cavity_group = g.cavity_group)
"""

LEVELS = PROFILE + """,
lv AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand AS model, cavity_group, rack_count, floor_usable, l_linenumber - 1 AS level,
    list_transform(range(0, 9), lambda k: ((l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + 13 * k * (l_linenumber + 1)) % 41)::DOUBLE / 10) AS raw
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN profile ON p_brand = name
  WHERE l_linenumber - 1 <= rack_count AND (l_linenumber > 1 OR floor_usable)),
ok AS (SELECT *, list_transform(range(CASE WHEN floor_usable THEN 0 ELSE 1 END, rack_count + 1), lambda k: raw[k + 1]) AS held, CASE WHEN floor_usable THEN 0 ELSE 1 END AS low FROM lv),
pr AS (SELECT *, list_max(held) AS top, (list_position(held, list_max(held)) - 1 + low)::INT AS pred, 1.0 / list_sum(list_transform(held, lambda x: exp(x - list_max(held)))) AS conf FROM ok)
"""

EVENTS = "ev AS (SELECT event_type AS cls, 1 / (1 + value / 50) AS score, (user_id + floor(value)::BIGINT) % 3 = 0 AS target FROM events)"
DOCS = """
dl AS (SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
ev AS (SELECT 'quality' AS cls, (n_chars * 7) % 997 / 997.0::DOUBLE AS score, quality = 1 AS target FROM dl WHERE quality IS NOT NULL
       UNION ALL SELECT 'toxic', (n_chars * 13) % 997 / 997.0::DOUBLE, toxic = 1 FROM dl WHERE toxic IS NOT NULL)
"""
BLOCKS = """,
d AS (SELECT cls, score, count(*) AS n_here, count(*) FILTER (WHERE target) AS tp_here FROM ev GROUP BY cls, score),
bl AS (SELECT *, sum(n_here) OVER w AS n, sum(tp_here) OVER w AS tp, sum(n_here) OVER (PARTITION BY cls) AS n_all, sum(tp_here) OVER (PARTITION BY cls) AS n_pos, lead(score, 1, 0.0) OVER w AS lower
       FROM d WINDOW w AS (PARTITION BY cls ORDER BY score DESC)),
ap AS (SELECT cls, sum(tp_here / nullif(n_pos, 0)::DOUBLE * tp / n) AS ap, max(n_pos)::BIGINT AS positives, max(n_all)::BIGINT AS n FROM bl GROUP BY cls)
"""
STATS = """,
c AS (SELECT cls, count(*) AS n, count(*) FILTER (WHERE score >= 0.5 AND target) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT target) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND target) AS fn, count(*) FILTER (WHERE score < 0.5 AND NOT target) AS tn FROM ev GROUP BY cls),
st AS (SELECT cls, n, tp + fn AS positives, round((tp + tn) / n, 6) AS acc, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c)
"""

# ---------------------------------------------------------------- retrieval

ORACLE_SQL["retrieve_vote"] = f"WITH {VOTE} SELECT q_id, model, cavity_group, round(confidence, 6) AS confidence, round(top1_sim, 6) AS top1_sim FROM match"
ORACLE_SQL["knn_topk"] = f"WITH {EMB} SELECT q_id, ref_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM nn"
ORACLE_SQL["top1_similarity"] = f"WITH {EMB} SELECT q_id, round(sim, 6) AS s FROM nn WHERE rank = 1"
ORACLE_SQL["retrieval_report"] = f"""WITH {FACTS} SELECT count(*) AS n, count(*) FILTER (WHERE external) AS n_external,
  round(avg(correct::INT) FILTER (WHERE inside), 6) AS top1, round(avg(rejected::INT) FILTER (WHERE inside), 6) AS unknown_rate, round(avg(rejected::INT) FILTER (WHERE NOT inside), 6) AS unseen_reject_rate,
  round(avg(rejected::INT) FILTER (WHERE external), 6) AS external_reject_rate, round(avg((NOT rejected)::INT) FILTER (WHERE external), 6) AS external_false_accept_rate, round(avg(top1_sim), 6) AS mean_top1_sim FROM facts"""
ORACLE_SQL["retrieval_confusion"] = f"WITH {FACTS} SELECT true_model, matched, count(*) AS n FROM facts GROUP BY ALL"
ORACLE_SQL["external_rejection"] = f"WITH {FACTS} SELECT true_model, count(*) AS n, count(*) FILTER (WHERE rejected) AS n_rejected FROM facts WHERE external GROUP BY true_model"
ORACLE_SQL["gallery_cap"] = """SELECT ref_id, model, cavity_group FROM (SELECT vec_id AS ref_id, 'M' || label AS model, 'G' || (label // 2) AS cavity_group,
  row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || vec_id), vec_id) AS n FROM embeddings WHERE label < 8) WHERE n <= 20"""

# ---------------------------------------------------------------- metrics, calibration

ORACLE_SQL["binary_stats"] = f"WITH {EVENTS}{STATS} SELECT * FROM st"
ORACLE_SQL["average_precision"] = f"WITH {EVENTS}{BLOCKS} SELECT cls, round(ap, 6) AS ap, positives, n FROM ap"
_ML = f"{DOCS}{STATS}{BLOCKS}, ml AS (SELECT st.cls, CASE WHEN st.positives > 0 AND st.positives < st.n THEN round(ap.ap, 6) END AS ap, precision, recall, f1, st.positives AS support, st.n - st.positives AS negatives, ap.ap AS exact FROM st JOIN ap ON st.cls = ap.cls)"
ORACLE_SQL["multilabel_report"] = f"WITH {_ML} SELECT * EXCLUDE exact FROM ml"
ORACLE_SQL["multilabel_map"] = f"WITH {_ML} SELECT round(avg(exact) FILTER (WHERE ap IS NOT NULL), 6) AS map, count(ap) AS n_classes FROM ml"
ORACLE_SQL["weighted_score"] = f"""WITH {EVENTS}{BLOCKS} SELECT round(sum(ap * weight) / sum(weight), 6) AS score
  FROM ap JOIN (VALUES ('click', 2.0::DOUBLE), ('purchase', 1.0), ('signup', 0.0), ('absent', 5.0)) w(cls, weight) ON ap.cls = w.cls WHERE weight > 0"""
ORACLE_SQL["best_f1_threshold"] = f"""WITH {EVENTS}{BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY 2 * tp / (n + n_pos)::DOUBLE DESC, score DESC) AS k FROM bl)
  SELECT cls, round(CASE WHEN n_pos = 0 OR n_pos = n_all THEN 0.5 ELSE (score + lower) / 2 END, 6) AS threshold, CASE WHEN n_pos = 0 OR n_pos = n_all THEN 'default' ELSE 'max_f1' END AS source FROM r WHERE k = 1"""
ORACLE_SQL["recall_target_threshold"] = f"""WITH {EVENTS}, p AS (SELECT cls, score, row_number() OVER (PARTITION BY cls ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY cls) AS n_pos FROM ev WHERE target),
  a AS (SELECT cls, count(*) AS n_all, count(*) FILTER (WHERE target) AS n_pos FROM ev GROUP BY cls)
  SELECT a.cls, round(CASE WHEN a.n_pos = 0 OR a.n_pos = n_all THEN 0.5 ELSE least(p.score, 0.5) END, 6) AS threshold, CASE WHEN a.n_pos = 0 OR a.n_pos = n_all THEN 'default' ELSE 'recall_target' END AS source
  FROM a LEFT JOIN p ON a.cls = p.cls AND p.k = greatest(1, ceil(0.95::DOUBLE * p.n_pos - 1e-9))"""
ORACLE_SQL["confidence_threshold"] = f"""WITH {EVENTS}{BLOCKS} SELECT cls, round(coalesce(min(score) FILTER (WHERE tp / n::DOUBLE >= 0.34), 0.5), 6) AS threshold,
  CASE WHEN count(*) FILTER (WHERE tp / n::DOUBLE >= 0.34) = 0 THEN 'default(target_unreachable)' ELSE 'target_precision' END AS source FROM bl GROUP BY cls"""
_TAU = """, vals AS (SELECT DISTINCT s FROM sc), cand AS (SELECT coalesce((s + lead(s) OVER (ORDER BY s)) / 2, s + 1e-4) AS tau FROM vals UNION ALL SELECT min(s) - 1e-4 FROM vals),
  ev2 AS (SELECT tau, avg((s >= tau)::INT) FILTER (WHERE inside) AS a, avg((s < tau)::INT) FILTER (WHERE NOT inside) AS r, count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_out FROM cand, sc GROUP BY tau)
  SELECT round(tau, 6) AS tau, round((a + r) / 2, 6) AS balanced_acc, round(a, 6) AS in_accept_rate, round(r, 6) AS out_reject_rate, n_in, n_out FROM ev2 ORDER BY round((a + r) / 2, 12) DESC, tau LIMIT 1"""
ORACLE_SQL["choose_tau_external"] = f"WITH {EMB}, sc AS (SELECT sim AS s, q_label < 8 AS inside FROM nn WHERE rank = 1){_TAU}"
ORACLE_SQL["choose_tau_loo"] = f"WITH {EMB}, sc AS (SELECT sim AS s, true AS inside FROM nn WHERE rank = 1 AND q_label < 8 UNION ALL SELECT max(sim), false FROM pairs WHERE q_label < 8 AND q_grp <> grp GROUP BY q_id){_TAU}"

# ---------------------------------------------------------------- racks

ORACLE_SQL["masked_softmax_argmax"] = f"WITH {LEVELS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, pred, round(conf, 6) AS conf FROM pr"
ORACLE_SQL["rack_report"] = f"""WITH {LEVELS} SELECT count(*) AS n, round(avg((pred = level)::INT), 6) AS acc, round(avg((pred >= 1 AND abs(pred - level) <= 1)::INT) FILTER (WHERE level >= 1), 6) AS acc_pm1,
  round(avg(((pred = 0) = (level = 0))::INT), 6) AS floor_acc, round(avg(conf), 6) AS mean_conf, round(avg((conf < 0.5)::INT), 6) AS low_conf_rate FROM pr"""
ORACLE_SQL["rack_per_model"] = f"WITH {LEVELS} SELECT model, level::INTEGER AS level, count(*) AS n, round(avg((pred = level)::INT), 6) AS acc FROM pr GROUP BY model, level"
ORACLE_SQL["rack_confusion"] = f"""WITH {LEVELS}, sz AS (SELECT model, max(rack_count) AS top FROM pr GROUP BY model), grid AS (SELECT model, a.k AS level, b.k AS pred FROM sz, range(0, 9) a(k), range(0, 9) b(k) WHERE a.k <= top AND b.k <= top)
  SELECT grid.model, grid.level::INTEGER AS level, grid.pred::INTEGER AS pred, count(pr.model) AS n FROM grid LEFT JOIN pr ON pr.model = grid.model AND pr.level = grid.level AND pr.pred = grid.pred GROUP BY ALL"""
ORACLE_SQL["cascade_report"] = f"""WITH {LEVELS}, f AS (SELECT *, CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN 'Brand#' || (1 + l_suppkey % 25) ELSE model END AS found FROM lv),
  m AS (SELECT f.*, p.rack_count AS rc, CASE WHEN p.floor_usable THEN 0 ELSE 1 END AS lo, p.cavity_group AS fg, list_transform(range(CASE WHEN p.floor_usable THEN 0 ELSE 1 END, p.rack_count + 1), lambda k: raw[k + 1]) AS held FROM f LEFT JOIN profile p ON f.found = p.name),
  x AS (SELECT coalesce(fg = cavity_group, false) AS d, CASE WHEN rc IS NULL THEN false ELSE list_position(held, list_max(held)) - 1 + lo = level END AS r FROM m)
  SELECT count(*) AS n, round(avg(d::INT), 6) AS device_acc, round(avg(r::INT), 6) AS rack_acc_e2e, round(avg((NOT r)::INT) FILTER (WHERE NOT d), 6) AS rack_err_given_device_err, round(avg((NOT r)::INT) FILTER (WHERE d), 6) AS rack_err_given_device_ok FROM x"""

# ---------------------------------------------------------------- rules, encoding

ORACLE_SQL["profile_unknown_anti"] = f"WITH {LABELS} SELECT device_model, count(*) AS n FROM j WHERE is_oven AND device_model IS NOT NULL AND NOT ext AND NOT in_profile GROUP BY device_model"
ORACLE_SQL["rule_issues"] = f"WITH {ISSUES} SELECT l_linenumber, device_model, level, code, count(*) AS n FROM log GROUP BY ALL"
ORACLE_SQL["issue_counts"] = f"WITH {ISSUES} SELECT level, code, count(*) AS n, min(l_orderkey) AS example FROM log GROUP BY level, code"
ORACLE_SQL["valid_label_count"] = f"""WITH {LABELS} SELECT is_oven, count(*) AS n FROM j WHERE NOT coalesce(
  (is_oven AND device_model IS NULL) OR (is_oven AND NOT ext AND ((device_model IS NOT NULL AND NOT in_profile) OR (in_profile AND (coalesce(rack_level > rack_count, false) OR coalesce(rack_level = 0 AND NOT floor_usable, false))))) OR (NOT is_oven AND device_model IS NOT NULL), false) GROUP BY is_oven"""
ORACLE_SQL["label_summary"] = f"""WITH {LABELS}, x AS (
  SELECT 'kind' AS field, CASE WHEN NOT is_oven THEN 'non_oven' WHEN ext THEN 'external' WHEN device_model IS NOT NULL THEN 'known' ELSE 'no_model' END AS value FROM j
  UNION ALL SELECT 'device_model', coalesce(device_model, 'unlabelled') FROM j WHERE is_oven
  UNION ALL SELECT 'food', coalesce(food_exist::VARCHAR, 'unlabelled') FROM j
  UNION ALL SELECT 'container', unnest(coalesce(container, ['unlabelled'])) FROM j
  UNION ALL SELECT 'accessory', unnest(coalesce(accessory, ['unlabelled'])) FROM j
  UNION ALL SELECT 'rack', coalesce(rack_level::VARCHAR, 'unlabelled') FROM j WHERE is_oven) SELECT field, value, count(*) AS n FROM x GROUP BY field, value"""
ORACLE_SQL["task_counts"] = f"""WITH {ENCODED} SELECT count(*) AS is_oven, count(*) FILTER (WHERE group_id >= 0) AS proj, count(food_exist) AS food, count(container) AS container, count(accessory) AS accessory,
  count(*) FILTER (WHERE device_known AND rack_level IS NOT NULL) AS rack FROM enc"""
ORACLE_SQL["coverage_unseen"] = "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"
ORACLE_SQL["multi_hot"] = "SELECT user_id, " + " || ".join(f"bool_or(event_type = '{t}')::INT::VARCHAR" for t in ("click", "error", "purchase", "signup", "view")) + " AS hot FROM events GROUP BY user_id"
ORACLE_SQL["known_masks"] = f"""WITH {ENCODED} SELECT l_linenumber, count(*) FILTER (WHERE device_known) AS device_known, count(food_exist) AS food_known, count(container) AS container_known, count(accessory) AS accessory_known,
  count(*) FILTER (WHERE device_known AND rack_level IS NOT NULL) AS rack_known FROM enc GROUP BY l_linenumber"""
ORACLE_SQL["group_ids"] = f"WITH {ENCODED} SELECT group_id, count(*) AS n FROM enc GROUP BY group_id"
ORACLE_SQL["pos_weight"] = f"""WITH {LABELS}, x AS (SELECT k - 1 AS cls, list_contains(container, ['glass', 'metal', 'foil'][k]) AS t FROM j, range(1, 4) r(k) WHERE container IS NOT NULL),
  n AS (SELECT cls::INTEGER AS cls, count(*) FILTER (WHERE t) AS pos, count(*) FILTER (WHERE NOT t) AS neg FROM x GROUP BY cls)
  SELECT cls, pos, neg, round(least(greatest(CASE WHEN pos > 0 AND neg > 0 THEN neg / pos ELSE 1 END, 1 / 3.0::DOUBLE), 3.0), 6) AS weight FROM n"""

# ---------------------------------------------------------------- content, splits, sampling

ORACLE_SQL["content_groups"] = """SELECT doc_id, strlen(text)::INTEGER AS size, CASE WHEN count(*) OVER (PARTITION BY strlen(text)) > 1 THEN sha256(text) ELSE 'file:' || doc_id END AS image_group FROM documents"""
_SPLIT = """f AS (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS a0, floor(n * 0.1::DOUBLE)::BIGINT AS b0, floor(n * 0.1::DOUBLE)::BIGINT AS c0 FROM s),
  q AS (SELECT *, n * 0.8::DOUBLE - a0 AS ra, n * 0.1::DOUBLE - b0 AS rb, n * 0.1::DOUBLE - c0 AS rc, n - a0 - b0 - c0 AS rest FROM f),
  u AS (SELECT *, a0 + ((rb > ra)::INT + (rc > ra)::INT < rest)::INT AS a1, b0 + ((ra >= rb)::INT + (rc > rb)::INT < rest)::INT AS b1, c0 + ((ra >= rc)::INT + (rb >= rc)::INT < rest)::INT AS c1 FROM q),
  z AS (SELECT *, CASE WHEN n >= 3 THEN (a1 = 0)::INT + (b1 = 0)::INT + (c1 = 0)::INT ELSE 0 END AS taken, greatest(a1, b1, c1) AS top FROM u),
  cnt AS (SELECT * EXCLUDE (a0, b0, c0, ra, rb, rc, rest, a1, b1, c1, taken, top),
    a1 + CASE WHEN n >= 3 AND a1 = 0 THEN 1 ELSE 0 END - CASE WHEN a1 = top THEN taken ELSE 0 END AS train,
    b1 + CASE WHEN n >= 3 AND b1 = 0 THEN 1 ELSE 0 END - CASE WHEN b1 = top AND a1 < top THEN taken ELSE 0 END AS val,
    c1 + CASE WHEN n >= 3 AND c1 = 0 THEN 1 ELSE 0 END - CASE WHEN c1 = top AND a1 < top AND b1 < top THEN taken ELSE 0 END AS test FROM z)"""
ORACLE_SQL["split_counts"] = f"WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), {_SPLIT} SELECT o_custkey, n, train::BIGINT AS train, val::BIGINT AS val, test::BIGINT AS test FROM cnt"
ORACLE_SQL["stratified_split"] = f"""WITH t AS (SELECT doc_id, lang, sha256(text) AS grp FROM documents),
  g AS (SELECT grp, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS stratum FROM t GROUP BY grp),
  k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || grp), grp) AS place FROM g),
  s AS (SELECT stratum, count(*) AS n FROM g GROUP BY stratum), {_SPLIT}
  SELECT t.doc_id, k.stratum, CASE WHEN place <= train THEN 'train' WHEN place <= train + val THEN 'val' ELSE 'test' END AS split FROM t JOIN k ON t.grp = k.grp JOIN cnt ON k.stratum = cnt.stratum"""
ORACLE_SQL["split_leakage"] = """WITH t AS (SELECT doc_id, strlen(text)::INTEGER AS size, sha256(text) AS sha256, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)
  SELECT size, sha256, count(*) AS n, count(DISTINCT split) AS n_splits, min(doc_id) AS example FROM t GROUP BY size, sha256 HAVING count(DISTINCT split) > 1"""
ORACLE_SQL["unique_stems"] = """WITH a AS (SELECT p_partkey, p_name, CASE WHEN count(*) OVER (PARTITION BY lower(p_name)) > 1 THEN p_name || '_' || substr(sha256(p_partkey::VARCHAR), 1, 12) ELSE p_name END AS o FROM part),
  k AS (SELECT *, row_number() OVER (PARTITION BY lower(o) ORDER BY p_partkey) AS n FROM a) SELECT p_partkey, p_name, CASE WHEN n > 1 THEN o || '_' || (n - 1) ELSE o END AS output_stem FROM k"""
_POOLS = "pools AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey % 6 WHEN c_nationkey < 23 THEN -1 ELSE -2 END AS pool FROM customer)"
ORACLE_SQL["pk_plan"] = f"WITH {_POOLS} SELECT least(4, count(DISTINCT pool) FILTER (WHERE pool >= 0))::INTEGER AS p, 8 AS n_oven, 4 AS n_non_oven, 4 AS n_unknown FROM pools"
ORACLE_SQL["pk_batches"] = f"""WITH {_POOLS}, drawn AS (SELECT b AS batch, pool, row_number() OVER (PARTITION BY b ORDER BY sha256('17|0|' || b || '|' || pool), pool) - 1 AS j FROM (SELECT unnest(range(count(*) // 8)) AS b FROM customer) r, (SELECT DISTINCT pool FROM pools WHERE pool >= 0)),
  need AS (SELECT batch, pool, j AS part, 2 AS take FROM drawn WHERE j < 4 UNION ALL SELECT b, -1, 1000000, 4 FROM (SELECT unnest(range(count(*) // 8)) AS b FROM customer) r UNION ALL SELECT b, -2, 1000001, 4 FROM (SELECT unnest(range(count(*) // 8)) AS b FROM customer) r),
  pos AS (SELECT *, sum(take) OVER (PARTITION BY pool ORDER BY batch) - take AS first, sum(take) OVER (PARTITION BY batch ORDER BY part) - take AS slot0 FROM need),
  want AS (SELECT batch, pool, (slot0 + i)::BIGINT AS slot, first + i AS ordinal FROM pos, range(0, 4) r(i) WHERE i < take),
  sz AS (SELECT pool, count(*) AS size FROM pools GROUP BY pool), cyc AS (SELECT want.*, (ordinal // size)::BIGINT AS cycle, ordinal % size AS at FROM want JOIN sz ON want.pool = sz.pool),
  rk AS (SELECT c.cycle, p.pool, p.c_custkey, row_number() OVER (PARTITION BY p.pool, c.cycle ORDER BY sha256('17|0|' || c.cycle || '|' || p.c_custkey), p.c_custkey) - 1 AS at FROM pools p JOIN (SELECT DISTINCT pool, cycle FROM cyc) c ON p.pool = c.pool)
  SELECT cyc.batch, cyc.slot, cyc.pool::INTEGER AS pool, rk.c_custkey FROM cyc JOIN rk ON cyc.pool = rk.pool AND cyc.cycle = rk.cycle AND cyc.at = rk.at"""
ORACLE_SQL["cyclic_draw"] = """WITH pools AS (SELECT c_mktsegment AS pool, c_custkey FROM customer), sz AS (SELECT pool, count(*) AS size FROM pools GROUP BY pool),
  cyc AS (SELECT pool, o AS ordinal, (o // size)::BIGINT AS cycle, o % size AS at FROM (SELECT pool, size, unnest(range(size * 5 // 2)) AS o FROM sz)),
  rk AS (SELECT c.cycle, p.pool, p.c_custkey, row_number() OVER (PARTITION BY p.pool, c.cycle ORDER BY sha256('7|0|' || c.cycle || '|' || p.c_custkey), p.c_custkey) - 1 AS at FROM pools p JOIN (SELECT DISTINCT pool, cycle FROM cyc) c ON p.pool = c.pool)
  SELECT cyc.pool, cyc.ordinal, rk.c_custkey FROM cyc JOIN rk ON cyc.pool = rk.pool AND cyc.cycle = rk.cycle AND cyc.at = rk.at"""
ORACLE_SQL["sequential_batches"] = "SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 16)::BIGINT AS batch FROM customer"
ORACLE_SQL["shuffled_batches"] = """SELECT c_custkey, batch FROM (SELECT c_custkey, ((row_number() OVER (ORDER BY sha256('5|' || c_custkey), c_custkey) - 1) // 16)::BIGINT AS batch, count(*) OVER () AS n FROM customer) WHERE batch < n // 16"""

# ---------------------------------------------------------------- losses

_LOGITS = """x AS (SELECT doc_id // 16 AS batch, (n_chars % 200 - 100) / 50.0::DOUBLE AS z, quality::DOUBLE AS t FROM documents d LEFT JOIN labels l USING (doc_id)),
  l AS (SELECT *, t * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) AS pos, (1 - t) * (ln(1 + exp(-abs(z))) + greatest(z, 0)) AS neg, 1 / (1 + exp(-z)) AS p FROM x)"""
ORACLE_SQL["bce_masked"] = f"WITH {_LOGITS} SELECT round(coalesce(avg(2 * pos + neg), 0), 6) AS loss, count(t) AS n FROM l"
ORACLE_SQL["focal_masked"] = f"WITH {_LOGITS} SELECT round(coalesce(avg((pos + neg) * (1 - (p * t + (1 - p) * (1 - t))) ** 2), 0), 6) AS loss, count(t) AS n FROM l"
ORACLE_SQL["batch_weighted_loss"] = f"WITH {_LOGITS} SELECT round(sum(pos + neg) / greatest(count(t), 1), 6) AS loss, count(t) AS n FROM l"
ORACLE_SQL["supcon"] = """WITH e AS (SELECT vec_id // 16 AS batch, vec_id AS i, label AS g, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  p AS (SELECT a.batch, a.i, a.g = b.g AS pos, list_cosine_similarity(a.v, b.v) / 0.1 AS x FROM e a JOIN e b ON a.batch = b.batch AND a.i <> b.i),
  k AS (SELECT batch, i, ln(sum(exp(x))) - sum(x) FILTER (WHERE pos) / count(*) FILTER (WHERE pos) AS loss, count(*) FILTER (WHERE pos) > 0 AND count(*) FILTER (WHERE NOT pos) > 0 AS anchor FROM p GROUP BY batch, i)
  SELECT batch, round(coalesce(avg(loss) FILTER (WHERE anchor), 0), 6) AS loss, count(*) FILTER (WHERE anchor) AS anchors FROM k GROUP BY batch"""
ORACLE_SQL["rack_ce_smoothed"] = f"""WITH {LEVELS}, n AS (SELECT *, top + ln(list_sum(list_transform(held, lambda x: exp(x - top)))) AS norm FROM pr),
  each AS (SELECT model, norm, level, raw, rack_count FROM n)
  SELECT model, round(avg(-((0.9::DOUBLE * (raw[level + 1] - norm)
     + CASE WHEN level >= 2 THEN 0.05::DOUBLE * (raw[level] - norm) ELSE 0 END + CASE WHEN level >= 1 AND level + 1 <= rack_count THEN 0.05::DOUBLE * (raw[level + 2] - norm) ELSE 0 END)
     / (0.9::DOUBLE + CASE WHEN level >= 2 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN level >= 1 AND level + 1 <= rack_count THEN 0.05::DOUBLE ELSE 0 END))), 6) AS loss, count(*) AS n FROM each GROUP BY model"""

# ---------------------------------------------------------------- decisions, reports

DECIDE = VOTE + """,
prof AS (SELECT DISTINCT 'M' || label AS name, 1 + label // 2 AS rack_count, (label // 2) % 2 = 0 AS floor_usable, CASE label % 3 WHEN 1 THEN ['tray'] WHEN 2 THEN ['tray', 'grill'] END AS supported FROM embeddings WHERE label < 8),
o AS (SELECT vec_id AS item, 0.6 + v[1] >= 0.5 AS oven, 0.5 + v[2] >= 0.5 AS food, list_filter([CASE WHEN 0.5 + v[3] >= 0.5 THEN 'glass' END, CASE WHEN 0.4 + v[4] >= 0.5 THEN 'metal' END], lambda x: x IS NOT NULL) AS cont,
             list_filter([CASE WHEN 0.5 + v[5] >= 0.5 THEN 'tray' END, CASE WHEN 0.4 + v[6] >= 0.5 THEN 'grill' END], lambda x: x IS NOT NULL) AS acc0, list_transform(v[7:12], lambda x: 10 * x) AS raw FROM e)
"""
_AFTER = """,
a AS (SELECT d.*, p.rack_count, p.floor_usable, CASE WHEN device IS NOT NULL AND supported IS NOT NULL THEN list_filter(acc0, lambda x: list_contains(supported, x)) ELSE acc0 END AS acc,
             list_transform(range(CASE WHEN p.floor_usable THEN 0 ELSE 1 END, p.rack_count + 1), lambda k: raw[k + 1]) AS held, CASE WHEN p.floor_usable THEN 0 ELSE 1 END AS lo FROM dev d LEFT JOIN prof p ON d.device = p.name),
lv2 AS (SELECT *, device IS NOT NULL AND (food OR len(cont) > 0 OR len(acc) > 0) AS leveled, (list_position(held, list_max(held)) - 1 + lo)::INT AS lvl, 1.0 / list_sum(list_transform(held, lambda x: exp(x - list_max(held)))) AS p FROM a),
res AS (SELECT item, oven AS is_oven, CASE WHEN NOT oven THEN '无' WHEN device IS NULL THEN '未知型号' ELSE device END AS device_model,
  round(CASE WHEN oven AND device IS NULL THEN top1_sim WHEN device IS NOT NULL THEN score END, 4) AS device_score, food AS food_exist, coalesce(list_aggregate(cont, 'string_agg', ','), '') AS container_type, coalesce(list_aggregate(acc, 'string_agg', ','), '') AS accessory_type,
  CASE WHEN leveled THEN lvl END::DOUBLE AS rack_level, round(CASE WHEN leveled THEN p END, 4) AS rack_level_score, coalesce(leveled AND (p < 0.5 OR (lvl >= 1 AND len(acc) = 0)), false) AS low_confidence, CASE WHEN oven AND device IS NULL THEN true END AS pending_gallery FROM lv2)
"""
_FOUND = DECIDE + ", dev AS (SELECT o.*, CASE WHEN oven AND m.cavity_group IS NOT NULL THEN m.model END AS device, m.confidence AS score, m.top1_sim FROM o LEFT JOIN match m ON o.item = m.q_id)" + _AFTER
_GIVEN = DECIDE + ", dev AS (SELECT o.*, CASE WHEN oven THEN 'M5' END AS device, 1.0::DOUBLE AS score, NULL::DOUBLE AS top1_sim FROM o)" + _AFTER
ORACLE_SQL["decision_pipeline"] = f"WITH {_FOUND} SELECT * FROM res"
ORACLE_SQL["decision_known_device"] = f"WITH {_GIVEN} SELECT * FROM res"
ORACLE_SQL["result_summary"] = f"""WITH {_FOUND}, x AS (SELECT 'images' AS field, 'all' AS value FROM res UNION ALL SELECT 'device_model', device_model FROM res UNION ALL SELECT 'rack_level', coalesce(rack_level::INT::VARCHAR, 'none') FROM res
  UNION ALL SELECT 'low_confidence', 'true' FROM res WHERE low_confidence) SELECT field, value, count(*) AS n FROM x GROUP BY field, value"""
ORACLE_SQL["pending_pool"] = f"WITH {_FOUND} SELECT item, device_score FROM res WHERE pending_gallery"
ORACLE_SQL["json_props_fields"] = "SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS sum_k, count(*) FILTER (WHERE (props::JSON ->> '$.k') IS NULL) AS n_missing FROM events GROUP BY event_type"
ORACLE_SQL["history_upsert"] = """WITH r AS (SELECT user_id AS epoch, datediff('day', DATE '2024-01-01', ts::DATE) AS seq, event_type AS metric, value FROM events)
  SELECT epoch, metric, value FROM r WHERE seq = (SELECT max(seq) FROM r s WHERE s.epoch = r.epoch) AND value IS NOT NULL"""
ORACLE_SQL["lr_schedule"] = """SELECT s AS step, round(CASE WHEN s < 455 THEN 1e-3 * (s + 1) / 455 ELSE 1e-6 + (1e-3 - 1e-6) * 0.5 * (1 + cos(pi() * least((s - 455) / 13195.0::DOUBLE, 1.0))) END, 9) AS lr FROM range(0, 13650) r(s)"""
ORACLE_SQL["parity_diff"] = """WITH x AS (SELECT c_mktsegment AS output, abs(c_acctbal - floor(c_acctbal * 10) / 10) AS gap FROM customer) SELECT output, round(max(gap), 6) AS max_abs, count(*) FILTER (WHERE gap > 0.05) AS n_over, count(*) AS n FROM x GROUP BY output"""
ORACLE_SQL["dir_eval_accuracy"] = """WITH x AS (SELECT o_custkey % 5 <> 0 OR o_orderstatus = 'X' AS same FROM orders WHERE o_totalprice > 1000),
  y AS (SELECT 'status' AS field, same FROM x UNION ALL SELECT 'priority', true FROM x UNION ALL SELECT 'both', true FROM x)
  SELECT field, count(*) FILTER (WHERE same) AS ok, count(*) AS total, round(avg(same::INT), 6) AS rate FROM y GROUP BY field"""

# ---------------------------------------------------------------- whole reports

ORACLE_SQL["preflight_report"] = f"""WITH {ISSUES}, s AS (SELECT *, CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM j),
  f AS (SELECT sha256(text) AS h, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents),
  c AS (SELECT 'label_errors' AS "check", count(*) FILTER (WHERE level = 'error') AS n, 0 AS lo, 0 AS hi FROM log
    UNION ALL SELECT 'leaked_contents', count(*), 0, 0 FROM (SELECT h FROM f GROUP BY h HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'train_groups', count(DISTINCT cavity_group), 2, 1000000 FROM s WHERE split = 'train' AND is_oven AND in_profile
    UNION ALL SELECT 'oven_kinds', count(DISTINCT is_oven), 2, 2 FROM s WHERE split = 'train'
    UNION ALL SELECT 'food_values', count(DISTINCT food_exist), 2, 2 FROM s WHERE split = 'train'
    UNION ALL SELECT 'models_unseen_in_train', count(*), 0, 0 FROM (SELECT DISTINCT device_model FROM s WHERE split = 'val' AND device_model IS NOT NULL EXCEPT SELECT device_model FROM s WHERE split = 'train'))
  SELECT "check", n, n BETWEEN lo AND hi AS ok FROM c"""

# ---------------------------------------------------------------- whole evaluations

ORACLE_SQL["best_checkpoint"] = """WITH RECURSIVE h AS (
    SELECT epoch, score, loss, row_number() OVER (ORDER BY epoch) AS k
    FROM (SELECT datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch, round(avg(value), 2) AS score, min(value) AS loss FROM events GROUP BY 1)),
  fold AS (SELECT k, epoch, score, loss, score AS s, loss AS l, true AS is_best FROM h WHERE k = 1
    UNION ALL SELECT k, epoch, score, loss, CASE WHEN better THEN score ELSE s END, CASE WHEN better THEN loss ELSE l END, better
      FROM (SELECT h.*, f.s, f.l, h.score > f.s + 1e-9 OR (abs(h.score - f.s) <= 1e-9 AND h.loss < f.l) AS better FROM fold f JOIN h ON h.k = f.k + 1))
  SELECT epoch, score, loss, is_best FROM fold"""

_OUT = """
orow AS (SELECT vec_id AS item, label <> 9 AS is_oven, CASE WHEN label <> 3 THEN label % 2 = 0 END AS food,
    CASE WHEN label <> 4 THEN [label % 3 = 0, label % 4 = 1] END AS container, CASE WHEN label <> 5 THEN [label % 3 = 1, label % 4 = 2] END AS accessory,
    0.6::DOUBLE + v[1] AS p_oven, 0.5::DOUBLE + v[2] AS p_food, [0.5::DOUBLE + v[3], 0.4::DOUBLE + v[4]] AS p_cont, [0.5::DOUBLE + v[5], 0.4::DOUBLE + v[6]] AS p_acc,
    label < 8 AS known, 1 + label // 2 AS rack_count, CASE WHEN (label // 2) % 2 = 0 THEN 0 ELSE 1 END AS low, list_transform(v[7:12], lambda x: 10 * x) AS raw, 1 + vec_id % (1 + label // 2) AS level FROM e),
ev AS (SELECT 'is_oven' AS cls, p_oven AS score, is_oven AS target FROM orow
    UNION ALL SELECT 'food', p_food, food FROM orow WHERE food IS NOT NULL
    UNION ALL SELECT 'container/' || ['glass', 'metal'][i], p_cont[i], container[i] FROM orow, range(1, 3) r(i) WHERE container IS NOT NULL
    UNION ALL SELECT 'accessory/' || ['tray', 'grill'][i], p_acc[i], accessory[i] FROM orow, range(1, 3) r(i) WHERE accessory IS NOT NULL{more}),
held AS (SELECT *, list_transform(range(low, rack_count + 1), lambda k: raw[k + 1]) AS held FROM orow WHERE known),
rk AS (SELECT item, level, list_position(held, list_max(held)) - 1 + low AS pred, 1.0::DOUBLE / list_sum(list_transform(held, lambda x: exp(x - list_max(held)))) AS conf FROM held)
"""
_BY_PLACE = """
    UNION ALL SELECT 'accessory_in_oven/' || ['tray', 'grill'][i], p_acc[i], accessory[i] FROM orow, range(1, 3) r(i) WHERE accessory IS NOT NULL AND is_oven
    UNION ALL SELECT 'accessory_out_oven/' || ['tray', 'grill'][i], p_acc[i], accessory[i] FROM orow, range(1, 3) r(i) WHERE accessory IS NOT NULL AND NOT is_oven"""


def _named(cte: str, suffix: str, size: int) -> str:
    """The retrieval CTEs under other names, over the first ``size`` components."""
    for name in ("pairs", "nn", "w", "gv", "mv", "tot", "best", "match", "facts"):
        cte = re.sub(rf"\b{name} AS \(", f"{name}{suffix} AS (", cte)
        cte = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{suffix}", cte)
    return cte.replace("list_cosine_similarity(q.v, r.v)", f"list_cosine_similarity(q.v[1:{size}], r.v[1:{size}])")


_DEVICES = """UNION ALL SELECT unnest(['device_top1{0}', 'device_unknown_rate{0}', 'external_reject_rate{0}', 'external_false_accept_rate{0}']), unnest([avg(correct::INT) FILTER (WHERE inside), avg(rejected::INT) FILTER (WHERE inside), avg(rejected::INT) FILTER (WHERE external), avg((NOT rejected)::INT) FILTER (WHERE external)]) FROM {1}"""
_CLS = _named(FACTS.split("e AS (SELECT", 1)[1].split("\n", 1)[1], "_c", 32)
ORACLE_SQL["full_evaluation"] = f"""WITH {FACTS}, {_CLS}, {_OUT.format(more=_BY_PLACE)}{BLOCKS},
  th AS (SELECT * FROM (VALUES ('is_oven', 0.55::DOUBLE), ('food', 0.45), ('container/metal', 0.35), ('accessory/tray', 0.6)) t(name, t)),
  judged AS (SELECT ev.*, score >= coalesce(t, 0.5) AS said FROM ev LEFT JOIN th ON name = regexp_replace(cls, '^accessory_(in|out)_oven/', 'accessory/')),
  c AS (SELECT cls, count(*) AS n, count(*) FILTER (WHERE said AND target) AS tp, count(*) FILTER (WHERE said AND NOT target) AS fp, count(*) FILTER (WHERE NOT said AND target) AS fn FROM judged GROUP BY cls),
  po AS (SELECT f.* FROM facts f JOIN orow ON f.q_id = item WHERE is_oven), pc AS (SELECT f.* FROM facts_c f JOIN orow ON f.q_id = item WHERE is_oven),
  cas AS (SELECT correct AS d, pred = level AND correct AS r FROM rk JOIN po ON q_id = item),
  out AS (
    SELECT cls || '_' || unnest(['acc', 'precision', 'recall', 'f1']) AS metric, unnest([(n - fp - fn) / n, tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0)]) AS value FROM c WHERE cls IN ('is_oven', 'food')
    UNION ALL SELECT split_part(cls, '/', 1) || '_map', avg(ap) FILTER (WHERE positives > 0 AND positives < n) FROM ap WHERE contains(cls, '/') GROUP BY 1
    UNION ALL SELECT 'safety_recall/metal', tp / nullif(tp + fn, 0) FROM c WHERE cls = 'container/metal'
    UNION ALL SELECT unnest(['rack_acc', 'rack_acc_pm1', 'rack_floor_acc', 'rack_mean_conf', 'rack_low_conf_rate']), unnest([avg((pred = level)::INT), avg((pred >= 1 AND abs(pred - level) <= 1)::INT) FILTER (WHERE level >= 1), avg(((pred = 0) = (level = 0))::INT), avg(conf), avg((conf < 0.4)::INT)]) FROM rk
    UNION ALL SELECT unnest(['rack_acc_e2e', 'rack_err_given_device_err']), unnest([avg(r::INT), avg((NOT r)::INT) FILTER (WHERE NOT d)]) FROM cas
    {_DEVICES.format("", "po")} {_DEVICES.format("_proj", "po")} {_DEVICES.format("_cls", "pc")})
  SELECT metric, round(value, 6) AS value FROM out"""

ORACLE_SQL["calibrate_all"] = f"""WITH {EMB}, {_OUT.format(more="")}{BLOCKS},
  f1 AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY 2 * tp / (n + n_pos)::DOUBLE DESC, score DESC) AS k, n_pos = 0 OR n_pos = n_all AS one FROM bl),
  rt AS (SELECT cls, max(score) FILTER (WHERE tp >= greatest(1, ceil(0.95::DOUBLE * n_pos - 1e-9))) AS s, max(n_pos) = 0 OR max(n_pos) = max(n_all) AS one FROM bl WHERE cls = 'container/metal' GROUP BY cls),
  rc AS (SELECT conf, sum(ok) OVER w / sum(n) OVER w::DOUBLE AS p FROM (SELECT conf, count(*) AS n, count(*) FILTER (WHERE pred = level) AS ok FROM rk GROUP BY conf) WINDOW w AS (ORDER BY conf DESC)),
  sc AS (SELECT sim AS s, q_label < 8 AS inside FROM nn WHERE rank = 1), best AS (SELECT tau FROM (WITH z AS (SELECT 1){_TAU}))
  SELECT cls AS name, round(CASE WHEN one THEN 0.5 ELSE (score + lower) / 2 END, 6) AS threshold, CASE WHEN one THEN 'default' ELSE 'max_f1' END AS source FROM f1 WHERE k = 1 AND cls <> 'container/metal'
  UNION ALL SELECT cls, round(CASE WHEN one THEN 0.5 ELSE least(s, 0.5) END, 6), CASE WHEN one THEN 'default' ELSE 'recall_target' END FROM rt
  UNION ALL SELECT 'rack_conf', round(coalesce(min(conf) FILTER (WHERE p >= 0.95), 0.5), 6), CASE WHEN count(*) FILTER (WHERE p >= 0.95) = 0 THEN 'default(target_unreachable)' ELSE 'target_precision' END FROM rc
  UNION ALL SELECT 'tau', tau, 'external' FROM best"""

# ---------------------------------------------------------------- annotations, manifests, parity

_RAW = """r AS (SELECT event_id, user_id % 6 AS d, event_id % 5 AS o, event_id % 7 AS f, event_id % 11 AS c, user_id % 8 AS k FROM events),
  a AS (SELECT *, CASE d WHEN 2 THEN '未知' WHEN 3 THEN 'A' WHEN 5 THEN 'B' END AS dv FROM r),
  n AS (SELECT *, CASE o WHEN 2 THEN true WHEN 3 THEN false ELSE dv IS NOT NULL END AS oven, coalesce(dv = '未知', false) AS ext FROM a)"""
ORACLE_SQL["generator_normalise"] = f"""WITH {_RAW}, x AS (SELECT *, CASE WHEN ext AND NOT oven THEN 'external_not_oven' WHEN NOT oven AND dv IS NOT NULL THEN 'device_not_oven' WHEN oven AND dv IS NULL THEN 'oven_without_device'
      WHEN f = 6 THEN 'food_not_boolean' WHEN c = 4 THEN 'bad_container_type' WHEN oven AND NOT ext AND k = 6 THEN 'bad_rack_level' END AS error FROM n)
  SELECT event_id, error, CASE WHEN error IS NULL THEN dv END AS device_model, CASE WHEN error IS NULL THEN oven END AS is_oven, CASE WHEN error IS NULL THEN CASE WHEN f IN (1, 5) THEN false WHEN f IN (2, 3) THEN true END END AS food_exist,
    CASE WHEN error IS NULL THEN CASE c WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'glass' WHEN 3 THEN 'metal' ELSE 'glass,metal' END END AS container,
    CASE WHEN error IS NULL AND oven AND NOT ext THEN CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 3 END END::INTEGER AS rack_level, error IS NULL AND oven AND NOT ext AND k = 4 AS several FROM x"""
_PARSED = _RAW + """, i AS (SELECT event_id, 'error' AS level, 'bad_type' AS code FROM n WHERE f = 6 UNION ALL SELECT event_id, 'warning', '遮挡' FROM n WHERE f = 4 UNION ALL SELECT event_id, 'warning', 'missing_field' FROM n WHERE f = 0
    UNION ALL SELECT event_id, 'warning', 'missing_field' FROM n WHERE c = 0 UNION ALL SELECT event_id, 'error', 'unknown_class' FROM n WHERE c = 4 UNION ALL SELECT event_id, 'warning', 'none_with_names' FROM n WHERE c > 4
    UNION ALL SELECT event_id, 'warning', 'missing_field' FROM n UNION ALL SELECT event_id, 'error', 'bad_rack_level' FROM n WHERE k IN (3, 4, 6))"""
ORACLE_SQL["annotation_issues"] = f"WITH {_PARSED} SELECT level, code, count(*) AS n FROM i GROUP BY level, code"
ORACLE_SQL["annotation_labels"] = f"""WITH {_PARSED} SELECT dv AS device_model, oven AS is_oven, CASE WHEN f IN (1, 5) THEN false WHEN f IN (2, 3) THEN true END AS food_exist, CASE c WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'glass' WHEN 3 THEN 'metal' ELSE 'glass,metal' END AS container,
    CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 END::INTEGER AS rack_level, count(*) AS n FROM n WHERE event_id NOT IN (SELECT event_id FROM i WHERE level = 'error') GROUP BY ALL"""
ORACLE_SQL["image_lookup"] = """SELECT '/d/' || page_id || '.json' AS json_path, CASE WHEN page_id % 3 = 0 AND page_id % 5 >= 1 THEN '/d/sub/' || page_id || '.png' WHEN page_id % 3 = 1 AND page_id % 5 >= 2 THEN '/d/x' || page_id || '.bmp'
    WHEN page_id % 5 = 4 THEN '/d/' || page_id || '.webp' WHEN page_id % 5 = 3 THEN '/d/' || page_id || '.JPG' END AS image_path FROM pages"""
ORACLE_SQL["split_summary"] = f"""WITH {LABELS} SELECT CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT device_model) AS n_models,
    count(*) FILTER (WHERE ext) AS n_external, count(*) FILTER (WHERE rack_level >= 5) AS n_multi_rack FROM j GROUP BY 1"""
ORACLE_SQL["bundle_faults"] = """SELECT DISTINCT 'M' || label AS model, CASE WHEN label = 6 THEN 'not_in_profile' ELSE 'other_group' END AS fault FROM embeddings WHERE label IN (3, 6)"""
ORACLE_SQL["refs_per_model"] = f"WITH {EMB} SELECT model, grp AS cavity_group, count(*) AS n FROM e WHERE label < 8 GROUP BY ALL"
ORACLE_SQL["arcface"] = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT label AS g, arg_min(v, vec_id) AS c FROM e WHERE vec_id % 25 = label GROUP BY label),
    x AS (SELECT vec_id, label = g AS own, least(greatest(list_cosine_similarity(v, c), -1 + 1e-7), 1 - 1e-7) AS cos FROM e, c),
    y AS (SELECT vec_id, own, 30 * CASE WHEN NOT own THEN cos WHEN cos > cos(pi() - 0.3) THEN cos * cos(0.3) - sqrt(1 - cos * cos) * sin(0.3) ELSE cos - sin(pi() - 0.3) * 0.3 END AS x FROM x),
    z AS (SELECT vec_id, max(x) FILTER (WHERE own) AS t, ln(sum(exp(x))) AS l FROM y GROUP BY vec_id)
  SELECT vec_id % 10 AS part, round(avg(l - t), 6) AS loss, count(t) AS n FROM z GROUP BY 1"""
ORACLE_SQL["vector_parity"] = """WITH e AS (SELECT label::VARCHAR AS output, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding, lambda x: floor(x::DOUBLE * 20) / 20) AS w FROM embeddings),
    g AS (SELECT *, list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - w[i]))) AS gap, list_cosine_similarity(v, w) AS cosine, list_position(v, list_max(v)) <> list_position(w, list_max(w)) AS other FROM e)
  SELECT output, round(max(gap), 6) AS max_abs, round(min(cosine), 6) AS min_cosine, count(*) FILTER (WHERE other) AS n_mismatch, count(*) AS n, max(gap) <= 0.05 AND min(cosine) >= 0.98 AS ok FROM g GROUP BY output"""
ORACLE_SQL["running_means"] = "SELECT event_type AS metric, round(avg(value) FILTER (WHERE event_id % 10 > 1), 6) AS mean, count(*) FILTER (WHERE event_id % 10 > 1) AS n FROM events GROUP BY event_type"
_MANIFEST = "m AS (SELECT o_orderstatus AS s, o_custkey AS key, max(o_orderpriority) AS value FROM orders GROUP BY ALL), f AS (SELECT key, value FROM m WHERE s = 'F'), o AS (SELECT key, value FROM m WHERE s = 'O')"
ORACLE_SQL["manifest_override"] = f"WITH {_MANIFEST} SELECT coalesce(o.key, f.key) AS key, coalesce(o.value, f.value) AS value FROM f FULL JOIN o ON f.key = o.key"
ORACLE_SQL["manifest_faults"] = f"WITH {_MANIFEST} SELECT coalesce(o.key, f.key) AS key, f.value AS ours, o.value AS theirs FROM f FULL JOIN o ON f.key = o.key WHERE f.value IS DISTINCT FROM o.value"
ORACLE_SQL["first_by_priority"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderstatus = 'O', o_orderkey LIMIT 400"
ORACLE_SQL["preflight_counts"] = f"""WITH {ENCODED}, s AS (SELECT *, CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM enc),
  x AS (SELECT split, 'task' AS field, 'is_oven' AS value FROM s UNION ALL SELECT split, 'task', 'proj' FROM s WHERE group_id >= 0 UNION ALL SELECT split, 'task', 'food' FROM s WHERE food_exist IS NOT NULL
    UNION ALL SELECT split, 'task', 'container' FROM s WHERE container IS NOT NULL UNION ALL SELECT split, 'task', 'accessory' FROM s WHERE accessory IS NOT NULL UNION ALL SELECT split, 'task', 'rack' FROM s WHERE device_known AND rack_level IS NOT NULL
    UNION ALL SELECT split, 'group', group_id::VARCHAR FROM s)
  SELECT split, field, value, count(*) AS n FROM x GROUP BY ALL"""

# ---------------------------------------------------------------- folders and documents

ORACLE_SQL["learning_rates"] = """WITH n AS (SELECT max(event_id) + 1 AS n FROM events)
  SELECT event_id AS step, round(CASE WHEN event_id < 455 THEN 1e-3 * (event_id + 1) / 455 ELSE 1e-6 + (1e-3 - 1e-6) * 0.5 * (1 + cos(pi() * least((event_id - 455) / greatest(1, n - 455)::DOUBLE, 1.0))) END, 9) AS lr FROM events, n"""
_FOLDER = """r AS (SELECT event_id AS e, '/d/' || (event_id % 7) || '/' || event_id || '.jpg' AS image, CASE WHEN user_id % 4 < 3 THEN 'text:M' || (user_id % 4) END AS pd, CASE WHEN user_id % 3 = 0 THEN 'list:[]' ELSE 'list:["油纸"]' END AS pc,
    CASE WHEN event_id % 2 = 0 THEN 'list:["a","b"]' ELSE 'list:[]' END AS pa, 'text:' || (event_id % 3) AS pr, event_id % 13 <> 1 AS said, user_id AS u FROM events WHERE event_id % 11 <> 0 AND event_id % 13 NOT IN (0, 2, 3)),
  t AS (SELECT *, CASE WHEN said AND u % 3 < 2 THEN 'text:M' || (u % 3) END AS td, CASE WHEN said THEN CASE u % 5 WHEN 2 THEN 'list:["油纸"]' WHEN 3 THEN 'list:["x","油纸"]' WHEN 4 THEN 'text:油纸' ELSE 'list:[]' END END AS tc,
    CASE WHEN said THEN CASE e % 4 WHEN 0 THEN 'list:["a","b"]' WHEN 2 THEN 'list:[]' WHEN 3 THEN 'text:True' END END AS ta,
    CASE WHEN said THEN CASE e % 6 WHEN 1 THEN 'text:1' WHEN 2 THEN 'text:2' WHEN 3 THEN 'text:0' WHEN 4 THEN 'text:1.0' WHEN 5 THEN 'list:["2","None"]' END END AS tr FROM r),
  x AS (SELECT image, 'device_model' AS field, pd AS predicted, td AS expected FROM t UNION ALL SELECT image, 'container_type', pc, tc FROM t UNION ALL SELECT image, 'accessory_type', pa, ta FROM t UNION ALL SELECT image, 'rack_level', pr, tr FROM t)
"""
ORACLE_SQL["folder_accuracy"] = f"""WITH {_FOLDER} SELECT field, count(*) FILTER (WHERE predicted IS NOT DISTINCT FROM expected) AS ok, count(*) AS total,
  round(count(*) FILTER (WHERE predicted IS NOT DISTINCT FROM expected) / count(*)::DOUBLE, 4) AS rate FROM x GROUP BY field"""
ORACLE_SQL["folder_errors"] = f"""WITH {_FOLDER}, w AS (SELECT * FROM x WHERE predicted IS DISTINCT FROM expected)
  SELECT image, field, predicted, expected FROM w UNION ALL SELECT image, NULL, NULL, NULL FROM r WHERE image NOT IN (SELECT image FROM w)"""

_SETTINGS = """m AS (SELECT o_orderkey AS id, o_orderkey % 101 = 0 AS broken, o_orderkey % 101 <> 0 AND o_orderkey % 103 = 0 AS listed, o_orderkey % 7 AS n, o_orderkey % 5 AS f, o_orderkey % 4 AS b, o_orderkey % 3 AS t, o_orderkey % 9 AS s FROM orders),
  g AS (SELECT * FROM m WHERE NOT broken AND NOT listed)"""
ORACLE_SQL["manifest_values"] = f"""WITH {_SETTINGS}, v AS (
    SELECT '' AS path, CASE WHEN broken THEN 'broken' WHEN listed THEN 'list' ELSE 'object' END AS kind, CASE WHEN broken OR listed THEN '' ELSE concat_ws('|', CASE WHEN n > 0 THEN n END, CASE WHEN f > 0 THEN 'f' || f END, 'b' || b, 't' || t, CASE WHEN s > 0 THEN 's' || s END) END AS value FROM m
    UNION ALL SELECT unnest(['[0]', '[1]']), 'int', unnest(['1', '2']) FROM m WHERE listed
    UNION ALL SELECT 'n', ['null', 'int', 'float', 'bool', 'int', 'int'][n], n::VARCHAR FROM g WHERE n > 0
    UNION ALL SELECT 'f', ['string', 'string', 'float', 'float'][f], f::VARCHAR FROM g WHERE f > 0
    UNION ALL SELECT 'b', ['bool', 'int', 'int', 'string'][b + 1], b::VARCHAR FROM g
    UNION ALL SELECT 't', ['string', 'string', 'int'][t + 1], t::VARCHAR FROM g
    UNION ALL SELECT 's', CASE s WHEN 5 THEN 'int' WHEN 7 THEN 'null' ELSE 'object' END, s::VARCHAR FROM g WHERE s > 0
    UNION ALL SELECT 's.c', 'string', s::VARCHAR FROM g WHERE s IN (1, 2, 4)
    UNION ALL SELECT 's.l', 'list', s::VARCHAR FROM g WHERE s IN (3, 4, 8)
    UNION ALL SELECT unnest(['s.l[0]', 's.l[1]']), 'string', unnest(['a', ' a']) FROM g WHERE s = 3
    UNION ALL SELECT 's.l[0]', 'string', 'bad' FROM g WHERE s = 8
    UNION ALL SELECT unnest(['s.zz', 's.zz.deep', 's.zz.deep[0]', 's.zz.deep[1]', 's.zz.deep[1].er']), unnest(['object', 'list', 'int', 'object', 'float']), 'one' FROM g WHERE s = 6)
  SELECT path, kind, count(*) AS n, count(DISTINCT value) AS n_values FROM v GROUP BY path, kind"""
ORACLE_SQL["manifest_rules"] = f"""WITH {_SETTINGS}
  SELECT id, '' AS path, CASE WHEN broken THEN 'broken' ELSE 'type' END AS fault FROM m WHERE broken OR listed
  UNION ALL SELECT id, 'n', ['missing', 'missing', '', 'type', 'type', 'range', 'range'][n + 1] FROM g WHERE n <> 2
  UNION ALL SELECT id, 'f', CASE f WHEN 2 THEN 'type' ELSE 'range' END FROM g WHERE f IN (2, 3)
  UNION ALL SELECT id, 'b', 'type' FROM g WHERE b IN (2, 3)
  UNION ALL SELECT id, 't', CASE t WHEN 1 THEN 'blank' ELSE 'type' END FROM g WHERE t > 0
  UNION ALL SELECT id, 's', CASE s WHEN 5 THEN 'type' ELSE 'unknown_key' END FROM g WHERE s IN (5, 6)
  UNION ALL SELECT id, 's.c', 'choice' FROM g WHERE s = 2
  UNION ALL SELECT id, 's.l', CASE s WHEN 3 THEN 'repeated' WHEN 4 THEN 'empty' WHEN 8 THEN 'never' ELSE 'missing' END FROM g WHERE s <> 5
  UNION ALL SELECT id, 'f', 'at_most' FROM g WHERE n = 5 AND f <> 2"""
ORACLE_SQL["manifest_resolved"] = f"""WITH {_SETTINGS} SELECT id, 'f' AS path, ['0.5', '0.25', 'x', '1', '0.5'][f + 1] AS value FROM g UNION ALL SELECT id, 't', [' a ', '', '5'][t + 1] FROM g
  UNION ALL SELECT id, 's.c', CASE s WHEN 1 THEN 'X' WHEN 2 THEN 'q' WHEN 4 THEN 'y' ELSE '"x"' END FROM g"""
_RUNS = """ev AS (SELECT event_type AS run, user_id, dayofweek(ts) + 1 AS day FROM events), dd AS (SELECT run, day, count(*) AS n, max(user_id) AS last FROM ev GROUP BY run, day), ww AS (SELECT run, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY run)"""
ORACLE_SQL["nested_report"] = f"""WITH {_RUNS} SELECT run, '{{"by_day":{{' || (SELECT string_agg('"' || day || '":{{"last":' || last || ',"n":' || n || '}}', ',' ORDER BY day::VARCHAR) FROM dd WHERE dd.run = ww.run) || '}},"n":' || n || ',"users":' || users || '}}' AS document FROM ww"""
ORACLE_SQL["metric_lines"] = f"""WITH {_RUNS} SELECT run, 'n=' || n || '.0 by_day.1.n=' || coalesce((SELECT n || '.0' FROM dd WHERE dd.run = ww.run AND day = 1), '-') || ' loss=-' AS line FROM ww"""
ORACLE_SQL["provenance"] = """SELECT 's' || event_id || '.json' AS json_name, 's' || event_id || '.jpg' AS image_name, '/in/' || event_id || '.json' AS source_json, '/in/' || event_id || '.JPG' AS source_image, 's' || event_id || '.jpg' AS image, '/out/train' AS image_root, true AS kept FROM events WHERE event_id % 3 <> 0"""
ORACLE_SQL["ordered_digest"] = """WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey::VARCHAR, p_name) - 1 AS i, sha256(strlen(p_partkey::VARCHAR) || ':' || p_partkey || strlen(p_name) || ':' || p_name) AS d FROM part),
  a AS (SELECT i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, count(*) AS n FROM r GROUP BY 1), b AS (SELECT i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, sum(n) AS n FROM a GROUP BY 1), c AS (SELECT i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, sum(n) AS n FROM b GROUP BY 1)
  SELECT sum(n)::BIGINT AS n, left(sha1(string_agg(d, '' ORDER BY i)), 16) AS digest FROM c"""
ORACLE_SQL["ordered_images"] = """WITH f AS (SELECT DISTINCT (page_id % 2)::INTEGER AS root, url || '/' || page_id || ['.jpg', '.JPG', '.txt', '.Png', '', '.webp'][page_id % 6 + 1] AS path FROM pages WHERE page_id % 6 NOT IN (2, 4))
  SELECT root, path, row_number() OVER (ORDER BY root, path) - 1 AS number FROM f"""

# ---------------------------------------------------------------- batches and folds

_VECTORS = """e AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  w AS (SELECT *, vec_id % 97 = 5 OR vec_id % 89 = 3 AS misshapen, vec_id % 97 = 5 OR (vec_id % 83 = 2 AND vec_id % 89 <> 3) AS unfinite,
    CASE WHEN vec_id % 97 = 5 THEN [] WHEN vec_id % 89 = 3 THEN v[1:60] WHEN vec_id % 83 = 2 THEN list_concat(v[1:7], v[9:64]) ELSE v END AS good FROM e),
  bb AS (SELECT batch, count(*)::INTEGER AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS items, round(min(list_min(good)), 6) AS least, round(max(list_max(good)), 6) AS most, bool_or(misshapen) AS shape, bool_or(unfinite) AS nf FROM w GROUP BY batch)
"""
ORACLE_SQL["collated_batches"] = f"WITH {_VECTORS} SELECT batch, n, items, least, most, concat_ws(',', CASE WHEN shape THEN 'shape' END, CASE WHEN nf THEN 'not_finite' END, CASE WHEN n <> 16 THEN 'size' END) AS faults FROM bb"
ORACLE_SQL["loader_faults"] = f"WITH {_VECTORS}, x AS (SELECT 'shape' AS fault, count(*) FILTER (WHERE shape) AS n FROM bb UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE nf) FROM bb UNION ALL SELECT 'size', count(*) FILTER (WHERE n <> 16) FROM bb) SELECT * FROM x WHERE n > 0"
ORACLE_SQL["batch_counts"] = f"""WITH {ENCODED}, s AS (SELECT *, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 64 AS batch FROM enc),
  k AS (SELECT batch, count(*) AS is_oven, count(*) FILTER (WHERE group_id >= 0) AS proj, count(food_exist) AS food, count(container) AS container, count(accessory) AS accessory, count(*) FILTER (WHERE device_known AND rack_level IS NOT NULL) AS rack FROM s GROUP BY batch)
  SELECT batch, 'task' AS field, unnest(['is_oven', 'proj', 'food', 'container', 'accessory', 'rack']) AS value, unnest([is_oven, proj, food, container, accessory, rack]) AS n FROM k
  UNION ALL SELECT batch, 'group', group_id::VARCHAR, count(*) FROM s GROUP BY ALL"""
_FOLDS = f"""{EMB}, gs AS (SELECT DISTINCT grp FROM e WHERE label < 8), qs AS (SELECT vec_id AS q_id, grp FROM e WHERE label < 8),
  fs AS (SELECT g.grp AS fold, q.q_id, q.grp, (SELECT max(sim) FROM pairs p WHERE p.q_id = q.q_id AND p.grp <> g.grp) AS s FROM gs g CROSS JOIN qs q)"""
ORACLE_SQL["leave_group_out"] = f"""WITH {_FOLDS}, x AS (SELECT fold, count(*) FILTER (WHERE grp <> fold) AS n_in, count(*) FILTER (WHERE grp = fold) AS n_out, avg(coalesce(s >= 0.35, false)::INT) FILTER (WHERE grp <> fold) AS a, avg((NOT coalesce(s >= 0.35, false))::INT) FILTER (WHERE grp = fold) AS r FROM fs GROUP BY fold)
  SELECT fold, n_in, n_out, round(a, 6) AS in_accept_rate, round(r, 6) AS out_reject_rate, round((a + r) / 2, 6) AS balanced_acc FROM x"""
ORACLE_SQL["fold_tau"] = f"""WITH {_FOLDS}, sc AS (SELECT (SELECT max(sim) FROM pairs p WHERE p.q_id = q.q_id) AS s, true AS inside FROM qs q UNION ALL SELECT s, false FROM fs WHERE grp = fold AND s IS NOT NULL){_TAU}"""
_LIMIT = "(SELECT threshold FROM cal WHERE name = '{}')"
_CALIBRATED = _FOUND
for _text, _name in (("0.6 + v[1] >= 0.5", "is_oven"), ("0.5 + v[2] >= 0.5", "food"), ("0.5 + v[3] >= 0.5", "container/glass"), ("0.4 + v[4] >= 0.5", "container/metal"), ("0.5 + v[5] >= 0.5", "accessory/tray"), ("0.4 + v[6] >= 0.5", "accessory/grill")):
    _CALIBRATED = _CALIBRATED.replace(_text, _text.replace("0.5", _LIMIT.format(_name)) if not _text.startswith("0.5") else f"0.5 + {_text[6:10]} >= {_LIMIT.format(_name)}")
_CALIBRATED = _CALIBRATED.replace("(p < 0.5 OR", f"(p < {_LIMIT.format('rack_conf')} OR").replace("top1 >= 0.35", f"top1 >= {_LIMIT.format('tau')}")
ORACLE_SQL["decision_calibrated"] = f"""WITH cal AS (SELECT name, threshold FROM ({ORACLE_SQL["calibrate_all"]})), {_CALIBRATED}
  SELECT res.*, round(0.6 + v[1], 4) AS score_is_oven, round(0.4 + v[4], 4) AS score_metal, round(0.5 + v[5], 4) AS score_tray FROM res JOIN e ON item = vec_id"""
ORACLE_SQL["decision_mismatches"] = f"""WITH x AS (WITH {_FOUND} SELECT * FROM res), y AS (WITH {_GIVEN} SELECT * FROM res), z AS (SELECT x.item, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS o,
    unnest(['is_oven', 'device_model', 'pending_gallery', 'device_score', 'food_exist', 'container_type', 'accessory_type', 'rack_level', 'rack_level_score', 'low_confidence']) AS field,
    unnest([x.is_oven::VARCHAR, x.device_model, x.pending_gallery::VARCHAR, x.device_score::VARCHAR, x.food_exist::VARCHAR, x.container_type, x.accessory_type, x.rack_level::INT::VARCHAR, x.rack_level_score::VARCHAR, x.low_confidence::VARCHAR]) AS a,
    unnest([y.is_oven::VARCHAR, y.device_model, y.pending_gallery::VARCHAR, y.device_score::VARCHAR, y.food_exist::VARCHAR, y.container_type, y.accessory_type, y.rack_level::INT::VARCHAR, y.rack_level_score::VARCHAR, y.low_confidence::VARCHAR]) AS b
    FROM x JOIN y USING (item)),
  d AS (SELECT * FROM z WHERE a IS DISTINCT FROM b AND NOT (o IN (4, 9) AND coalesce(abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(b AS DOUBLE)) <= 1e-3, false)))
  SELECT item, field, CASE WHEN o NOT IN (4, 9) THEN array_to_string(list_sort(string_split(a, ',')), ',') END AS ref, CASE WHEN o NOT IN (4, 9) THEN array_to_string(list_sort(string_split(b, ',')), ',') END AS got, o = min(o) OVER (PARTITION BY item) AS first FROM d"""

_BCE = "({t}) * (ln(1 + exp(-abs({z}))) + greatest(-({z}), 0)) + (1 - ({t})) * (ln(1 + exp(-abs({z}))) + greatest({z}, 0))"
_MANY = "list_sum(list_transform(range(1, 3), lambda i: " + _BCE.format(t="{t}[i]::INT::DOUBLE", z="{z}[i]") + ")) / 2"
ORACLE_SQL["batch_losses"] = f"""WITH {EMB}, {_OUT.format(more="")}, o AS (SELECT *, item // 16 AS batch FROM orow), h AS (SELECT *, list_transform(range(low, rack_count + 1), lambda k: raw[k + 1]) AS hh FROM o),
  t AS (SELECT batch, coalesce(avg({_BCE.format(t="is_oven::INT::DOUBLE", z="p_oven")}), 0) AS is_oven, coalesce(avg({_BCE.format(t="food::INT::DOUBLE", z="p_food")}), 0) AS food, coalesce(avg({_MANY.format(t="container", z="p_cont")}), 0) AS container,
    coalesce(avg({_MANY.format(t="accessory", z="p_acc")}), 0) AS accessory, coalesce(avg(CASE WHEN known THEN list_max(hh) + ln(list_sum(list_transform(hh, lambda x: exp(x - list_max(hh))))) - raw[level + 1] END), 0) AS rack FROM h GROUP BY batch),
  p AS (SELECT a.vec_id // 16 AS batch, a.vec_id AS i, a.grp = b.grp AS pos, list_cosine_similarity(a.v, b.v) / 0.1 AS x FROM e a JOIN e b ON a.vec_id // 16 = b.vec_id // 16 AND a.vec_id <> b.vec_id WHERE a.label < 8 AND b.label < 8),
  k AS (SELECT batch, i, ln(sum(exp(x))) - sum(x) FILTER (WHERE pos) / count(*) FILTER (WHERE pos) AS loss, count(*) FILTER (WHERE pos) > 0 AND count(*) FILTER (WHERE NOT pos) > 0 AS anchor FROM p GROUP BY batch, i),
  s AS (SELECT batch, coalesce(avg(loss) FILTER (WHERE anchor), 0) AS proj FROM k GROUP BY batch), j AS (SELECT t.*, coalesce(proj, 0) AS proj FROM t LEFT JOIN s USING (batch))
  SELECT batch, round(is_oven, 6) AS is_oven, round(proj, 6) AS proj, round(food, 6) AS food, round(container, 6) AS container, round(accessory, 6) AS accessory, round(rack, 6) AS rack,
    round(is_oven + 0.5 * proj + food + 2 * container + 1.5 * accessory + 0.25 * rack, 6) AS total FROM j"""
ORACLE_SQL["coverage_warnings"] = f"""WITH {LABELS}, tr AS (SELECT * FROM j WHERE l_suppkey % 10 <> 0 AND is_oven AND coalesce(food_exist, true) AND NOT list_contains(accessory, 'spit') AND device_model <> 'Brand#11'), va AS (SELECT * FROM j WHERE l_suppkey % 10 = 0)
  SELECT 'few_groups' AS warning, count(DISTINCT cavity_group)::VARCHAR AS value FROM tr WHERE is_oven AND in_profile HAVING count(DISTINCT cavity_group) < 2
  UNION ALL SELECT 'only_ovens', NULL FROM tr HAVING count(*) FILTER (WHERE NOT is_oven) = 0
  UNION ALL SELECT 'one_food_value', min(food_exist)::VARCHAR FROM tr HAVING count(DISTINCT food_exist) = 1
  UNION ALL SELECT 'unseen_container', x FROM (SELECT unnest(container) AS x FROM va EXCEPT SELECT unnest(container) FROM tr)
  UNION ALL SELECT 'unseen_accessory', x FROM (SELECT unnest(accessory) AS x FROM va EXCEPT SELECT unnest(accessory) FROM tr)
  UNION ALL SELECT 'unseen_model', x FROM (SELECT device_model AS x FROM va WHERE device_model IS NOT NULL EXCEPT SELECT device_model FROM tr)"""

ORACLE_SQL["preflight_verdict"] = f"""WITH r AS (SELECT "check", ok FROM ({ORACLE_SQL["preflight_report"]}) UNION ALL SELECT 'loader_' || fault, false FROM ({ORACLE_SQL["loader_faults"]}))
  SELECT CASE WHEN bool_and(ok) THEN 'passed' ELSE 'failed' END AS status, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE NOT ok), '') AS failed FROM r"""

ORACLE_SQL["endless_positions"] = "SELECT event_type AS consumer, event_id AS request, k // 37 AS epoch, k % 37 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events)"
