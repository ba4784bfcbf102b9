"""Named queries bound to the driver's tables; each reads its tables whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import columns
from tarnwork.functions.columns import first_argmax, level_mask, softmax
from tarnwork.operators import batches, calibration, decide, documents, encode, evaluate, folder_eval, folds, losses, metrics, numbering, report, retrieval, rules, sampling, split
from tarnwork.operators.vectors import nearest
from tarnwork.plans import bindings as b
from tarnwork.sources import annotations, generator, listing
from tarnwork.sources.profile import with_provenance
from tarnwork.sources.scratch import folder, stored
from tarnwork.streaming import sampler

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(*cols: str, places: int = 6):
    return [F.round(c, places).alias(c) for c in cols]


# ---------------------------------------------------------------- retrieval


@query
def retrieve_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = b.vectors(spark, sf_dir)
    return retrieval.match(queries, refs, 10, b.TAU).select("q_id", "model", "cavity_group", *_r("confidence", "top1_sim"))


@query
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = b.vectors(spark, sf_dir)
    return nearest(queries, refs, 10).select("q_id", "ref_id", *_r("sim"), "rank")


@query
def top1_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = b.vectors(spark, sf_dir)
    return retrieval.top1(queries, refs).select("q_id", *_r("s"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = b.vectors(spark, sf_dir)
    truth = queries.select("q_id", F.col("model").alias("true_model"), F.col("cavity_group").alias("true_group"), "external")
    return retrieval.retrieval_facts(retrieval.match(queries, refs, 10, b.TAU), truth, refs)


@query
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.retrieval_report(_facts(spark, sf_dir))
    return out.select("n", "n_external", *_r("top1", "unknown_rate", "unseen_reject_rate", "external_reject_rate", "external_false_accept_rate", "mean_top1_sim"))


@query
def retrieval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieval_confusion(_facts(spark, sf_dir))


@query
def external_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).where("external")
    return facts.groupBy("true_model").agg(F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected"))


@query
def gallery_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.capped(b.vectors(spark, sf_dir)[1], 20, 42).select("ref_id", "model", "cavity_group")


# ---------------------------------------------------------------- metrics, calibration


@query
def binary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.binary_stats(b.event_scores(spark, sf_dir), F.lit(0.5), ["cls"])
    return out.select("cls", "n", "positives", *_r("acc", "precision", "recall", "f1"))


@query
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(b.event_scores(spark, sf_dir), ["cls"]).select("cls", *_r("ap"), "positives", "n")


@query
def multilabel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.multilabel_report(b.document_scores(spark, sf_dir), F.lit(0.5))
    return out.select("cls", *_r("ap", "precision", "recall", "f1"), "support", "negatives")


@query
def multilabel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.mean_average_precision(metrics.multilabel_report(b.document_scores(spark, sf_dir), F.lit(0.5)))
    return out.select(*_r("map"), "n_classes")


@query
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = metrics.average_precision(b.event_scores(spark, sf_dir), ["cls"]).select(F.col("cls").alias("metric"), F.col("ap").alias("value"))
    weights = spark.createDataFrame([("click", 2.0), ("purchase", 1.0), ("signup", 0.0), ("absent", 5.0)], "metric string, weight double")
    return metrics.weighted_score(values, weights).select(*_r("score"))


@query
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.best_f1_threshold(b.event_scores(spark, sf_dir), keys=["cls"]).select("cls", *_r("threshold"), "source")


@query
def recall_target_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.recall_target_threshold(b.event_scores(spark, sf_dir), 0.95, keys=["cls"]).select("cls", *_r("threshold"), "source")


@query
def confidence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.precision_target_threshold(b.event_scores(spark, sf_dir), 0.34, keys=["cls"]).select("cls", *_r("threshold"), "source")


def _tau(scores: DataFrame) -> DataFrame:
    return calibration.choose_tau(scores).select(*_r("tau", "balanced_acc", "in_accept_rate", "out_reject_rate"), "n_in", "n_out")


@query
def choose_tau_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tau(calibration.tau_scores(*b.vectors(spark, sf_dir))[0])


@query
def choose_tau_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tau(calibration.tau_scores(*b.vectors(spark, sf_dir))[1])


# ---------------------------------------------------------------- racks


@query
def masked_softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.masked_levels(b.level_rows(spark, sf_dir))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "pred", *_r("conf"))


@query
def rack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.rack_report(metrics.masked_levels(b.level_rows(spark, sf_dir)), 0.5)
    return out.select("n", *_r("acc", "acc_pm1", "floor_acc", "mean_conf", "low_conf_rate"))


@query
def rack_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rack_by(metrics.masked_levels(b.level_rows(spark, sf_dir)), "model", "level").select("model", "level", "n", *_r("acc"))


@query
def rack_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rack_confusion(metrics.masked_levels(b.level_rows(spark, sf_dir)))


@query
def cascade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("l_suppkey") % 9 == 0, None).when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("Brand#"), (1 + F.col("l_suppkey") % 25).cast("string"))).otherwise(F.col("model"))
    spec = b.brand_profile(spark, sf_dir).select(F.col("name").alias("found"), F.col("rack_count").alias("rc"), F.col("floor_usable").alias("fu"), F.col("cavity_group").alias("fg"))
    rows = b.level_rows(spark, sf_dir).withColumn("found", found).join(spec, "found", "left")
    pred = first_argmax(softmax(level_mask(F.col("raw"), F.col("rc"), F.col("fu"))))
    rows = rows.select(F.coalesce(F.col("fg") == F.col("cavity_group"), F.lit(False)).alias("device_ok"), F.when(F.col("rc").isNull(), False).otherwise(pred == F.col("level")).alias("rack_ok"))
    return metrics.cascade_report(rows).select("n", *_r("device_acc", "rack_acc_e2e", "rack_err_given_device_err", "rack_err_given_device_ok"))


# ---------------------------------------------------------------- rules, encoding


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_labels(b.item_labels(spark, sf_dir), b.brand_profile(spark, sf_dir))


@query
def profile_unknown_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unknown_models(b.item_labels(spark, sf_dir), b.brand_profile(spark, sf_dir))


@query
def rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _checked(spark, sf_dir).select("l_linenumber", "device_model", F.explode("issues").alias("i"))
    return log.groupBy("l_linenumber", "device_model", "i.level", "i.code").agg(F.count("*").alias("n"))


@query
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.issue_counts(rules.issue_log(_checked(spark, sf_dir), "l_orderkey"), "l_orderkey")


@query
def valid_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.valid_labels(_checked(spark, sf_dir)).groupBy("is_oven").agg(F.count("*").alias("n"))


@query
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.label_summary(b.item_labels(spark, sf_dir))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(b.item_labels(spark, sf_dir), b.brand_profile(spark, sf_dir), b.CONTAINERS, b.ACCESSORIES)


@query
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.task_counts(_encoded(spark, sf_dir))


@query
def coverage_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders")
    return rules.unseen(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "o_custkey")


@query
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return users.select("user_id", F.array_join(F.transform(columns.multi_hot(F.col("types"), ("click", "error", "purchase", "signup", "view")), lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query
def known_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("device_known", "food_known", "container_known", "accessory_known", "rack_known")
    return _encoded(spark, sf_dir).groupBy("l_linenumber").agg(*[F.count_if(c).alias(c) for c in flags])


@query
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n"))


@query
def pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.pos_weight(_encoded(spark, sf_dir), "container_hot", "container_known", 3.0).select("cls", "pos", "neg", *_r("weight"))


# ---------------------------------------------------------------- content, splits, sampling


@query
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return split.content_groups(docs, "doc_id", "text").select("doc_id", "size", "image_group")


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = b.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    train, val, test = split.split_counts(F.col("n"))
    return sizes.select("o_custkey", "n", train.alias("train"), val.alias("val"), test.alias("test"))


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("grp"))
    return split.stratified_split(docs, "grp", "lang").select("doc_id", "stratum", "split")


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test").alias("split"))
    return split.split_leakage(docs, "doc_id", "text").select("size", "sha256", "n", "n_splits", "example")


@query
def unique_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.unique_stems(b.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return b.table(spark, sf_dir, "customer").select("c_custkey", F.when(nation < 20, nation % 6).when(nation < 23, -1).otherwise(-2).alias("group_id"))


@query
def pk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = sampling.plan_quota(*sampling.pool_counts(_pools(spark, sf_dir)))
    return spark.createDataFrame([(quota.p, quota.n_oven, quota.n_non_oven, quota.n_unknown)], "p int, n_oven int, n_non_oven int, n_unknown int")


@query
def pk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = _pools(spark, sf_dir)
    return sampling.pk_batches(pools, "c_custkey", sampling.plan_quota(*sampling.pool_counts(pools)), pools.count() // 8, seed=17)


@query
def cyclic_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = b.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pool"), "c_custkey")
    last = F.floor(F.count("*") * 5 / 2) - 1  # two and a half cycles
    demand = pool.groupBy("pool").agg(last.alias("last")).select("pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("ordinal"))
    return sampling.cyclic_draw(pool, "c_custkey", demand, 7).select("pool", "ordinal", "c_custkey")


@query
def sequential_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sampling.sequential_batches(rows, "c_custkey", 16).select("c_custkey", "batch")


@query
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sampling.sequential_batches(rows, "c_custkey", 16, shuffle_seed=5, drop_last=True).select("c_custkey", "batch")


# ---------------------------------------------------------------- losses


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.document_labels(spark, sf_dir)
    return rows.select(F.floor(F.col("doc_id") / 16).alias("batch"), ((F.col("n_chars") % 200 - 100) / 50.0).alias("logit"), F.coalesce(F.col("quality"), F.lit(0)).cast("double").alias("t"), F.col("quality").isNotNull().alias("known"))


@query
def bce_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir)
    return rows.agg(F.round(losses.masked_mean(losses.bce(F.col("logit"), F.col("t"), 2.0), F.col("known")), 6).alias("loss"), F.count_if("known").alias("n"))


@query
def focal_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir)
    return rows.agg(F.round(losses.masked_mean(losses.focal(F.col("logit"), F.col("t")), F.col("known")), 6).alias("loss"), F.count_if("known").alias("n"))


@query
def batch_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = losses.batch_parts(_logits(spark, sf_dir), losses.bce(F.col("logit"), F.col("t")), F.col("known"))
    return losses.combine_batches(parts).select(*_r("loss"), "n")


@query
def supcon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), F.col("vec_id").alias("item"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return losses.supcon(rows).select("batch", *_r("loss"), "anchors")


@query
def rack_ce_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.level_rows(spark, sf_dir)
    loss = losses.level_cross_entropy(F.col("raw"), F.col("level"), F.col("rack_count"), F.col("floor_usable"), 0.1)
    return rows.groupBy("model").agg(F.round(F.avg(loss), 6).alias("loss"), F.count("*").alias("n"))


# ---------------------------------------------------------------- decisions, reports


def _decided(spark: SparkSession, sf_dir: str, device: str | None = None) -> DataFrame:
    outputs = b.model_outputs(spark, sf_dir)
    profile = b.model_profile(spark, sf_dir)
    if device is not None:  # a given device needs no match
        return decide.decide(decide.unmatched(outputs), profile, b.CONTAINERS[:2], b.ACCESSORIES[:2], device_model=device)
    queries, refs = b.vectors(spark, sf_dir)
    ovens = queries.join(outputs.where("is_oven_prob >= 0.5").select(F.col("item").alias("q_id")), "q_id", "left_semi")  # before the search
    found = retrieval.match(ovens, refs, 10, b.TAU).withColumnRenamed("q_id", "item")
    return decide.decide(outputs.join(found, "item", "left"), profile, b.CONTAINERS[:2], b.ACCESSORIES[:2])


def _flat(results: DataFrame) -> DataFrame:
    return results.withColumns({c: F.array_join(c, ",") for c in ("container_type", "accessory_type")} | {"rack_level": F.col("rack_level").cast("double")})


@query
def decision_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_decided(spark, sf_dir))


@query
def decision_known_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_decided(spark, sf_dir, "M5"))


@query
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.result_summary(_decided(spark, sf_dir))


@query
def pending_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.pending(_decided(spark, sf_dir)).select("item", "device_score")


@query
def json_props_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return b.table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.count_if(F.col("k").isNull()).alias("n_missing"))


@query
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch"), F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("seq"), F.col("event_type").alias("metric"), "value")
    return report.upsert_history(rows.where("metric <> 'click'"), rows.where("metric = 'click'"))


@query
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at every event, taken as the steps of one training."""
    steps = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    last = steps.agg(F.max("step")).first()[0]
    return steps.select("step", F.round(report.learning_rate(F.col("step"), last + 1, 455, 1e-3, 1e-6), 9).alias("lr"))


@query
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lr_schedule(spark, 13_650, 455, 1e-3, 1e-6).select("step", *_r("lr", places=9))


@query
def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six training losses of every batch of 16 embeddings, and their weighted sum."""
    queries, _ = b.vectors(spark, sf_dir)
    rows = _output_rows(spark, sf_dir).join(queries.select(F.col("q_id").alias("item"), "v", "cavity_group"), "item").withColumn("batch", F.floor(F.col("item") / 16))
    for name in ("is_oven", "food", "container", "accessory"):
        rows = rows.withColumnRenamed(f"{name}_prob", f"{name}_logit")
    weights = {"is_oven": 1.0, "proj": 0.5, "food": 1.0, "container": 2.0, "accessory": 1.5, "rack": 0.25}
    return losses.batch_losses(rows, weights, b.CONTAINERS[:2], b.ACCESSORIES[:2]).select("batch", *_r(*losses.LOSS_TERMS, "total"))


@query
def coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation is what one supplier in ten delivers; training lacks spits, food labels of one kind and some brands."""
    labels = b.item_labels(spark, sf_dir)
    train = labels.where("l_suppkey % 10 <> 0 AND is_oven AND coalesce(food_exist, true) AND NOT array_contains(accessory, 'spit') AND device_model <> 'Brand#11'")
    split = train.withColumn("split", F.lit("train")).unionByName(labels.where("l_suppkey % 10 = 0").withColumn("split", F.lit("val")))
    return rules.coverage(split, b.brand_profile(spark, sf_dir))


@query
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    history = b.table(spark, sf_dir, "events").groupBy(day.alias("epoch")).agg(F.round(F.avg("value"), 2).alias("score"), F.min("value").alias("loss"))
    return report.best_epochs(history)


@query
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("output"), F.col("c_acctbal").alias("value"))
    other = rows.withColumn("value", F.floor(F.col("value") * 10) / 10)
    return report.parity(rows, other, 0.05).select("output", *_r("max_abs"), "n_over", "n")


@query
def dir_eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders")
    said = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("both"))
    truth = orders.where("o_totalprice > 1000").select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("both"))
    return report.field_accuracy(said, truth, ["status", "priority", "both"], "o_orderkey").select("field", "ok", "total", *_r("rate"))


# ---------------------------------------------------------------- whole reports


def _output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs of every embedding row with labels derived from its label number."""
    n = F.col("label")
    labels = b.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), (n != 9).alias("is_oven"), F.when(n != 3, n % 2 == 0).alias("food_exist"),
        F.when(n != 4, F.array_compact(F.array(F.when(n % 3 == 0, "glass"), F.when(n % 4 == 1, "metal")))).alias("container"),
        F.when(n != 5, F.array_compact(F.array(F.when(n % 3 == 1, "tray"), F.when(n % 4 == 2, "grill")))).alias("accessory"),
        (n < 8).alias("device_known"), F.concat(F.lit("M"), n.cast("string")).alias("name"),
    )
    spec = b.model_profile(spark, sf_dir).select("name", "rack_count", "floor_usable")
    rows = labels.join(b.model_outputs(spark, sf_dir), "item").join(spec, "name", "left")
    return rows.withColumn("rack_level", F.when(F.col("device_known"), 1 + (F.col("item") % F.col("rack_count")).cast("int")))


@query
def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _output_rows(spark, sf_dir), {}
    queries, refs = b.vectors(spark, sf_dir)
    ovens = queries.join(rows.where("is_oven").select(F.col("item").alias("q_id")), "q_id", "left_semi")  # retrieval is judged on ovens
    truth = queries.select("q_id", F.col("model").alias("true_model"), F.col("cavity_group").alias("true_group"), "external")
    for name, size in (("proj", 64), ("cls", 32)):  # a second feature: the first half of the vector
        q, r = (x.withColumn("v", F.slice("v", 1, size)) for x in (ovens, refs))
        features[name] = stored(retrieval.retrieval_facts(retrieval.match(q, r, 10, b.TAU), truth, r), "facts")
    levels = evaluate.known_levels(rows).select("item", (F.col("pred") == F.col("level")).alias("rack_ok"))
    facts = features["proj"]
    cascade = levels.join(facts.select(F.col("q_id").alias("item"), F.col("correct").alias("device_ok")), "item").select("device_ok", (F.col("rack_ok") & F.col("device_ok")).alias("rack_ok"))
    thresholds = spark.createDataFrame([("is_oven", 0.55), ("food", 0.45), ("container/metal", 0.35), ("accessory/tray", 0.6), ("rack_conf", 0.4)], "name string, threshold double")
    return evaluate.evaluate(rows, facts, cascade, b.CONTAINERS[:2], b.ACCESSORIES[:2], thresholds=thresholds, safety=("metal",), others=features).select("metric", *_r("value"))


@query
def calibrate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibrate(_output_rows(spark, sf_dir), *b.vectors(spark, sf_dir), b.CONTAINERS[:2], b.ACCESSORIES[:2], ("metal",)).select("name", *_r("threshold"), "source")


@query
def preflight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("l_orderkey") % 10 < 8, "train").when(F.col("l_orderkey") % 10 == 8, "val").otherwise("test")
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test").alias("split"))
    return evaluate.preflight(b.item_labels(spark, sf_dir).withColumn("split", share), b.brand_profile(spark, sf_dir), docs, "doc_id", "text")


# ---------------------------------------------------------------- annotations, manifests, parity


@query
def generator_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("error").isNull()
    out = generator.normalise(b.raw_annotations(spark, sf_dir))
    kept = [F.when(good, F.col(c)).alias(c) for c in ("device_model", "is_oven", "food_exist", "rack_level")]
    return out.select(F.col("json_path").cast("long").alias("event_id"), "error", *kept, F.when(good, F.array_join("container_type", ",")).alias("container"), (good & F.col("multi_rack_level").isNotNull()).alias("several"))


@query
def annotation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotations.parse(b.raw_annotations(spark, sf_dir), b.CONTAINERS, b.ACCESSORIES)
    issues = out.select(F.inline_outer("issues")).where("code IS NOT NULL")  # a plain inline would have the parser run again in a filter on the size
    return issues.groupBy("level", "code").agg(F.count("*").alias("n"))


@query
def annotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotations.parse(b.raw_annotations(spark, sf_dir), b.CONTAINERS, b.ACCESSORIES).where("valid")
    return out.groupBy("device_model", "is_oven", "food_exist", F.array_join("container", ",").alias("container"), "rack_level").agg(F.count("*").alias("n"))


@query
def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    named = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"image": "sub/'), page, F.lit('.png"}'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"annotations": {"image_name": "x'), page, F.lit('.bmp"}}'))).otherwise("{}")
    pages = b.table(spark, sf_dir, "pages")
    notes = pages.select(F.concat(F.lit("/d/"), page, F.lit(".json")).alias("json_path"), named.alias("raw"))
    kinds = F.array(F.concat(F.lit("/d/sub/"), page, F.lit(".png")), F.concat(F.lit("/d/x"), page, F.lit(".bmp")), F.concat(F.lit("/d/"), page, F.lit(".JPG")), F.concat(F.lit("/d/"), page, F.lit(".webp")))
    files = pages.select(F.explode(F.slice(kinds, 1, (F.col("page_id") % 5).cast("int"))).alias("path"))
    return annotations.with_image(notes, files).select("json_path", "image_path")


@query
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("l_orderkey") % 10 < 8, "train").when(F.col("l_orderkey") % 10 == 8, "val").otherwise("test")
    rows = b.item_labels(spark, sf_dir).withColumns({"split": share, "several": F.col("rack_level") >= 5})
    return split.split_summary(rows, "device_model", "several")


@query
def bundle_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = b.vectors(spark, sf_dir)[1].withColumn("cavity_group", F.when(F.col("model") == "M3", "G9").otherwise(F.col("cavity_group")))
    return retrieval.bundle_faults(refs, b.model_profile(spark, sf_dir).where("name <> 'M6'"))


@query
def refs_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.vectors(spark, sf_dir)[1].groupBy("model", "cavity_group").agg(F.count("*").alias("n"))


@query
def arcface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    centres = rows.where("item % 25 = grp").groupBy("grp").agg(F.min_by("v", "item").alias("c"))
    return losses.arcface(rows, centres).groupBy((F.col("item") % 10).alias("part")).agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("loss").alias("n"))


@query
def vector_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("output"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 20) / 20))
    return report.vector_parity(rows, other, 0.05, 0.98).select("output", *_r("max_abs", "min_cosine"), "n_mismatch", "n", "ok")


@query
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 10 == 1, float("inf")).otherwise(F.col("value"))
    return report.running_means(b.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), value.alias("value"))).select("metric", *_r("mean"), "n")


def _manifest(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))


@query
def manifest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overridden(_manifest(spark, sf_dir, "F"), _manifest(spark, sf_dir, "O"))


@query
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.incompatible(_manifest(spark, sf_dir, "F"), _manifest(spark, sf_dir, "O"))


@query
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_by_priority(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", ["P", "O"], 400)


@query
def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("l_orderkey") % 10 < 8, "train").when(F.col("l_orderkey") % 10 == 8, "val").otherwise("test")
    return evaluate.preflight_counts(_encoded(spark, sf_dir).withColumn("split", share))


# ---------------------------------------------------------------- folders and documents


def _folder_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder_eval.judged(b.folder_results(spark, sf_dir), folder_eval.truth_values(b.folder_notes(spark, sf_dir)))


@query
def folder_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder_eval.accuracy(_folder_verdicts(spark, sf_dir))


@query
def folder_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judged image, once for each field it got wrong."""
    return _folder_verdicts(spark, sf_dir).where("judged").select("image", F.inline_outer("errors"))


MANIFEST_RULES = (
    documents.Rule("n", "int", low=1, high=9), documents.Rule("f", "float", "0.5", low=0, high=1, low_open=True, high_open=True), documents.Rule("b", "bool"), documents.Rule("t", "str"),
    documents.Rule("s", "section", "{}", choices=("c", "l")), documents.Rule("s.c", "choice", '"x"', choices=("x", "y")), documents.Rule("s.l", "str_list", never=("bad",)),
)


@query
def manifest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each path holds each kind of value, at any depth."""
    values = documents.flattened(b.order_manifests(spark, sf_dir), "id")
    return values.groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of every order's settings."""
    values = stored(documents.flattened(b.order_manifests(spark, sf_dir), "id"), "manifest-values")
    return documents.faults(values, "id", MANIFEST_RULES, [documents.Relation("f", "at_most", "n")])


@query
def manifest_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = documents.flattened(b.order_manifests(spark, sf_dir).where("id % 101 <> 0 AND id % 103 <> 0"), "id")
    return documents.resolved(values, "id", MANIFEST_RULES).where("path IN ('f', 's.c', 't')")


def _event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, metric, value): counts of an event type, whole and by weekday."""
    events = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), "user_id", F.dayofweek("ts").cast("string").alias("day"))
    whole = events.groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select("run", F.inline(F.array(F.struct(F.lit("n").alias("metric"), F.col("n").alias("value")), F.struct(F.lit("users").alias("metric"), F.col("users").alias("value")))))
    days = events.groupBy("run", "day").agg(F.count("*").alias("n"), F.max("user_id").alias("last"))
    each = days.select("run", F.inline(F.array(*[F.struct(F.concat(F.lit("by_day."), F.col("day"), F.lit(f".{m}")).alias("metric"), F.col(m).alias("value")) for m in ("n", "last")])))
    return whole.unionByName(each)


@query
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.nested(_event_metrics(spark, sf_dir), "run")


@query
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metric_lines(_event_metrics(spark, sf_dir), "run", ["n", "by_day.1.n", "loss"], places=1)


@query
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the data set keeps of every event's annotation, with the names of its files."""
    notes = b.raw_annotations(spark, sf_dir).where("json_path % 3 <> 0")
    items = notes.select(F.concat(F.lit("/in/"), "json_path", F.lit(".json")).alias("json_path"), F.concat(F.lit("/in/"), "json_path", F.lit(".JPG")).alias("image_path"), "raw", F.concat(F.lit("s"), "json_path").alias("stem"), F.lit("train").alias("split"))
    doc = lambda key: F.expr(f"try_variant_get(parse_json(document), '$.{key}', 'string')")
    same = F.expr("try_variant_get(parse_json(document), '$.device_model', 'string')").eqNullSafe(F.expr("try_variant_get(parse_json(raw), '$.device_model', 'string')"))
    out = with_provenance(items, "/out/")
    return out.select("json_name", "image_name", doc("source_json").alias("source_json"), doc("source_image").alias("source_image"), doc("image").alias("image"), doc("image_root").alias("image_root"), same.alias("kept"))


@query
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.ordered_digest(b.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("content")), "key", "content")


@query
def ordered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, (".jpg", ".JPG", ".txt", ".Png", "", ".webp"))), (1 + F.col("page_id") % 6).cast("int"))
    files = b.table(spark, sf_dir, "pages").select((F.col("page_id") % 2).cast("int").alias("root"), F.concat("url", F.lit("/"), F.col("page_id").cast("string"), ends).alias("path"))
    return listing.ordered_images(files)


# ---------------------------------------------------------------- batches and folds


def _vector_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in batches of 16 by number; some are null, short or not finite."""
    i, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    bad = F.when(i % 97 == 5, None).when(i % 89 == 3, F.slice(v, 1, 60)).when(i % 83 == 2, F.transform(v, lambda x, k: F.when(k == 7, F.lit(float("nan"))).otherwise(x))).otherwise(v)
    rows = numbering.batched(numbering.numbered(b.table(spark, sf_dir, "embeddings").select("vec_id", bad.alias("v")), "vec_id"), 16)
    return batches.checked(batches.collated(rows, "vec_id", "v"), "v", 64, 16)


@query
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _vector_batches(spark, sf_dir)
    return out.select("batch", "n", F.array_join(F.transform("vec_id", lambda x: x.cast("string")), ",").alias("items"), *_r("least", "most"), F.array_join("faults", ",").alias("faults"))


@query
def loader_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.loader_faults(_vector_batches(spark, sf_dir))


@query
def preflight_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, leakage and coverage checks together with those of all batches."""
    return evaluate.verdict(preflight_report(spark, sf_dir), evaluate.loader_checks(_vector_batches(spark, sf_dir))).select("status", F.array_join("failed", ",").alias("failed"))


@query
def endless_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batch of which epoch each event takes, if every event of a type asks one sampler for the next batch."""
    asked = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("consumer"), F.col("event_id").alias("request"))
    at = f"{folder(spark)}/tarnwork-core/requests-{uuid.uuid4().hex}"
    asked.write.parquet(f"{at}/in")
    source = spark.readStream.schema("consumer STRING, request LONG").parquet(f"{at}/in")
    sampler.taken_positions(source, 37, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("consumer", "request", "epoch", "batch")


@query
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbering.batched(numbering.numbered(_encoded(spark, sf_dir), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 64)
    return batches.batch_counts(rows)


@query
def leave_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.leave_group_out(folds.fold_similarities(*b.vectors(spark, sf_dir)), b.TAU)
    return out.select("fold", "n_in", "n_out", *_r("in_accept_rate", "out_reject_rate", "balanced_acc"))


@query
def fold_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.choose_tau(folds.fold_scores(folds.fold_similarities(*b.vectors(spark, sf_dir))))
    return out.select(*_r("tau", "balanced_acc", "in_accept_rate", "out_reject_rate"), "n_in", "n_out")


@query
def decision_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision chain at the thresholds that the calibration of the same rows gives, with scores."""
    limits = decide.threshold_values(calibrate_all(spark, sf_dir))
    queries, refs = b.vectors(spark, sf_dir)
    outputs = b.model_outputs(spark, sf_dir)
    ovens = queries.join(outputs.where(F.col("is_oven_prob") >= limits["is_oven"]).select(F.col("item").alias("q_id")), "q_id", "left_semi")
    found = retrieval.match(ovens, refs, 10, limits["tau"]).withColumnRenamed("q_id", "item")
    out = decide.decide(outputs.join(found, "item", "left"), b.model_profile(spark, sf_dir), b.CONTAINERS[:2], b.ACCESSORIES[:2], thresholds=limits, with_scores=True)
    scores = [F.col("scores.is_oven").alias("score_is_oven"), F.try_element_at("scores.container", F.lit("metal")).alias("score_metal"), F.try_element_at("scores.accessory", F.lit("tray")).alias("score_tray")]
    return _flat(out).select("*", *scores).drop("scores")


@query
def decision_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a given device changes what the chain decides, field by field."""
    out = decide.mismatches(_decided(spark, sf_dir), _decided(spark, sf_dir, "M5"))
    number = F.col("field").isin("device_score", "rack_level_score")
    return out.select("item", "field", F.when(~number, F.col("ref")).alias("ref"), F.when(~number, F.col("got")).alias("got"), "first")
