"""Features, models, their quality, and numeric summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import learning as l
from ..operators import metrics as m
from ..operators import numeric as n
from .registry import plan


@plan("ratio_features", """
    select customer_id, income / nullif(age, 0) as income_age_ratio,
           credit_score / nullif(income, 0) * 1000 as credit_income_ratio,
           account_balance / nullif(transaction_count + 1, 0) as balance_transaction_ratio
    from features_v""")
def ratio_features(t):
    return f.ratio_features(t.features_v).select(
        "customer_id", "income_age_ratio", "credit_income_ratio", "balance_transaction_ratio"
    )


@plan("high_value_flag", """
    select customer_id, income, cast(coalesce(income > (select quantile_cont(income, 0.8) from features_v), false)
           as int) as high_value from features_v""")
def high_value_flag(t):
    return f.high_value_flag(t.features_v, "income").select("customer_id", "income", "high_value")


@plan("equal_width_bins", """
    with x as (select min(credit_score) as lo, max(credit_score) as hi from features_v)
    select customer_id, credit_score,
           cast(greatest(1, least(5, ceil((credit_score - lo) / ((hi - lo) / 5)))) as int) as band_no,
           ['Poor', 'Fair', 'Good', 'Very Good', 'Excellent'][
               cast(greatest(1, least(5, ceil((credit_score - lo) / ((hi - lo) / 5)))) as int)] as band
    from features_v, x""")
def equal_width_bins(t):
    return f.equal_width_bins(t.features_v.select("customer_id", "credit_score"), "credit_score")


_SCALED = ["income", "age", "account_balance", "constant"]


@plan("standard_scale", "with s as (select " + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _SCALED) + " from features_v) select customer_id, "
    + ", ".join(f"round(({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 6) as {c}" for c in _SCALED)
    + " from features_v, s")
def standard_scale(t):
    scaled = f.standard_scale(t.features_v, _SCALED)
    return scaled.select("customer_id", *[F.round(c, 6).alias(c) for c in _SCALED])


@plan("fraud_features", """
    select user_id, count(*) as events, cast(sum(cast(value as decimal(18,9))) as double) as total,
           cast(sum(cast(value as decimal(18,9))) as double) / count(*) as mean, max(value) as largest,
           cast(count(*) filter (where event_type = 'error') as double) / count(*) as error_share
    from events group by 1""")
def fraud_features(t):
    return f.fraud_features(t.events)


@plan("stratified_split", """
    select doc_id, label, place, place <= floor(n * 0.2::double) as is_test from (
        select doc_id, label, row_number() over (partition by label
                   order by md5(cast(doc_id as varchar) || '|42'), doc_id) as place,
               count(*) over (partition by label) as n from labelled_v)""")
def stratified_split(t):
    rows = t.labelled_v.select("doc_id", "label")
    return f.stratified_split(rows, "label", "doc_id")


@plan("train_models", """
    with s as (select label, place <= floor(n * 0.2::double) as is_test from (
        select label, row_number() over (partition by label
                   order by md5(cast(doc_id as varchar) || '|42'), doc_id) as place,
               count(*) over (partition by label) as n from labelled_v)),
    c as (select count(*) filter (where is_test and label = 1) as positives,
                 count(*) filter (where is_test and label = 0) as negatives,
                 count(*) filter (where not is_test) as validated from s)
    select model, cast(ordinal as int) as ordinal, positives, negatives, validated, true as learned
    from c, (values ('random_forest', 0), ('gradient_boosting', 1), ('logistic_regression', 2), ('svm', 3))
         as m(model, ordinal)""")
def train_models(t):
    """Counts of the confusion matrices that follow from the split, and whether each model's F1 reaches a half."""
    columns = ["chars", "words", "word_length", "digit_share", "newlines"]
    quality = l.train_models(t.labelled_v, "doc_id", "label", columns)
    return quality.select(
        "model", "ordinal", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
        "validated", (F.col("f1") >= 0.5).alias("learned"),
    )


@plan("classification_report", """
    with c as (select 0 as class union all select 1),
    s as (select class, count(*) filter (where label = class) as support,
                 count(*) filter (where prediction = class) as chosen,
                 count(*) filter (where prediction = class and label = class) as hit
          from c, predictions_v group by 1),
    r as (select class, support, coalesce(cast(hit as double) / nullif(chosen, 0), 0) as precision,
                 coalesce(cast(hit as double) / nullif(support, 0), 0) as recall from s)
    select cast(class as int) as class, precision, recall,
           coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, support,
           (select cast(count(*) filter (where label = prediction) as double) / count(*) from predictions_v)
               as accuracy from r""")
def classification_report(t):
    return m.classification_report(t.predictions_v)


@plan("roc_auc", """
    with r as (select label, rank() over (order by score) as lo,
                      count(*) over (partition by score) as ties from predictions_v),
    a as (select sum(case when label = 1 then lo + (ties - 1) / 2 end) as ranks,
                 count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as q from r)
    select p as positives, q as negatives,
           round((ranks - cast(p as double) * (p + 1) / 2) / (cast(p as double) * q), 9) as auc from a""")
def roc_auc(t):
    return m.roc_auc(t.predictions_v)


_BINARY = """
    b as (select model_no, cast(count(*) filter (where label = prediction) as double) / count(*) as accuracy,
                 coalesce(cast(2 * count(*) filter (where label = 1 and prediction = 1) as double)
                     / nullif(count(*) filter (where label = 1) + count(*) filter (where prediction = 1), 0), 0)
                     as f1
          from predictions_v group by 1)"""


@plan("select_best_model", f"""with {_BINARY}
    select 'model_' || cast(model_no as varchar) as best_model, f1 as best_f1, (select count(*) from b) as models
    from b order by f1 desc, model_no limit 1""")
def select_best_model(t):
    metrics = m.binary_metrics(t.predictions_v, "model_no").select(
        F.concat(F.lit("model_"), F.col("model_no").cast("string")).alias("model"),
        F.col("model_no").alias("ordinal"), "f1",
    )
    return m.select_best_model(metrics)


@plan("deploy_gate", f"with {_BINARY} select model_no, accuracy, f1 from b where accuracy > 0.51::double")
def deploy_gate(t):
    metrics = m.binary_metrics(t.predictions_v, "model_no")
    return m.deploy_gate(metrics.select("model_no", "accuracy", "f1"), 0.51)


@plan("accuracy_monitor", """
    with w as (select date_trunc('day', ts)::timestamp as window_start, count(*) as "rows",
                      cast(count(*) filter (where label = prediction) as double) / count(*) as accuracy
               from predictions_v group by 1)
    select *, case when accuracy < 0.5::double then 'retrain' when accuracy < 0.52::double then 'alert'
                   else 'ok' end as action from w""")
def accuracy_monitor(t):
    return m.accuracy_monitor(t.predictions_v, "1 day", 0.52, 0.5)


@plan("ab_test", """
    with p as (select variant, cast(count(*) as double) as n, cast(count(*) filter (where converted) as double) as x
               from variants_v group by 1),
    j as (select p.*, c.n as cn, c.x as cx, (p.x + c.x) / (p.n + c.n) as pool from p, p c where c.variant = 'A')
    select variant, cast(n as bigint) as n, x / n as rate,
           round((x / n - cx / cn) / (cx / cn), 9) as lift,
           round((x / n - cx / cn) / nullif(sqrt(pool * (1 - pool) * (1 / n + 1 / cn)), 0), 9) as z from j""")
def ab_test(t):
    return m.ab_test(t.variants_v)


@plan("metric_correlation", """
    select 'dag_' || cast(user_id % 5 as varchar) as dag_id, round(corr(value * 10, event_id % 8), 6) as correlation
    from events group by 1""")
def metric_correlation(t):
    return m.metric_correlation(t.task_runs_v, "dag_id", "duration_s", "cpu")


@plan("feature_drift", """
    with x as (select value, cast(regexp_extract(props, '([0-9]+)', 1) as double) as k,
                      ts >= timestamp '2024-01-24 00:00:00' as cur from events),
    l as (select 'value' as feature, value as v, cur from x union all select 'k', k, cur from x),
    e as (select feature, min(v) as lo, max(v) as hi from l where not cur group by 1),
    c as (select feature, case when v is null then -2 when v < lo then -1 when v > hi then 10
                              else least(9, coalesce(floor((v - lo) / (hi - lo) * 10), 0)) end as bin,
                 count(*) filter (where not cur) as p, count(*) filter (where cur) as q
          from l join e using (feature) group by 1, 2),
    t as (select feature, sum(p) as np, sum(q) as nq from c group by 1),
    s as (select feature, greatest(p / np, 1e-6) as p, greatest(q / nq, 1e-6) as q from c join t using (feature))
    select feature, round(sum((p - q) * ln(p / q)), 6) as psi from s group by 1""")
def feature_drift(t):
    events = t.events.select(
        "ts", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k")
    )
    recent = F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")
    return f.feature_drift(events.where(~recent), events.where(recent), ["value", "k"])


@plan("isolation_forest")
def isolation_forest(t):
    return l.isolation_forest(t.task_runs_v, "attempt_id", ["duration_s", "cpu_pct", "cpu"])


@plan("sentiment_score", """
    with w as (select doc_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), ' ')) as word
               from documents),
    s as (select doc_id, count(*) as hits, sum(polarity) as balance from w join lexicon_v using (word) group by 1)
    select d.doc_id, coalesce(hits, 0) as hits, cast(balance as double) / hits as sentiment
    from documents d left join s using (doc_id)""")
def sentiment_score(t):
    return f.sentiment_score(t.documents, t.lexicon_v)


@plan("batch_score_median", """
    with s as (select vec_id, cast(floor(vec_id / 100) as bigint) as batch,
                      cast(list_sum(list_transform(embedding,
                          lambda x: cast(cast(x as double) as decimal(18,9)))) as double) as score
               from embeddings),
    m as (select batch, median(score) as batch_median from s group by 1)
    select batch, vec_id, score, batch_median, score > batch_median as above_median from s join m using (batch)""")
def batch_score_median(t):
    return n.batch_score_median(t.embeddings, 100)


@plan("gram_matrix", """
    with c as (select vec_id, label, unnest(range(1, 65)) as i, embedding from embeddings),
    v as (select label, vec_id, i, cast(embedding[i] as double) as x from c)
    select a.label, cast(a.i as int) as i, cast(b.i as int) as j,
           cast(sum(cast(a.x * b.x as decimal(18,9))) as double) as product
    from v a join v b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2, 3""")
def gram_matrix(t):
    return n.gram_matrix(t.embeddings, "label")


@plan("svd_summary", """
    with c as (select vec_id, unnest(range(1, 65)) as i, embedding from embeddings),
    v as (select vec_id, i, cast(embedding[i] as double) as x from c),
    g as (select sum(a.x * b.x) as p from v a join v b using (vec_id) group by a.i, b.i),
    s as (select sum(x * x) as squares, count(distinct i) as width, count(distinct vec_id) as n from v)
    select cast(least(width, n) as bigint) as singular_values, round(squares / n, 6) as squares,
           round((select sum(p * p) from g) / n / n, 6) as fourth_powers, true as falling from s""")
def svd_summary(t):
    """What holds of all singular values together: their squares add up to the entries', their fourth powers to the products'."""
    values = n.svd_summary(t.embeddings, 10**6)
    v, rows = F.col("singular_value"), F.lit(t.embeddings.count())
    falls = F.lag(v).over(Window.orderBy("position")) >= v  # one row per column of a vector
    power = lambda e, per: F.round(F.sum(F.pow(v, F.lit(e))) / per, 6)
    return values.withColumn("falls", falls).agg(
        F.count(v).alias("singular_values"), power(2, rows).alias("squares"),
        power(4, rows * rows.cast("double")).alias("fourth_powers"), F.coalesce(F.bool_and("falls"), F.lit(True)).alias("falling"),
    )


@plan("top_singular_values")
def top_singular_values(t):
    return n.svd_summary(t.embeddings, 5)


@plan("series_spectrum", """
    with p as (select user_id, hour - min(hour) over (partition by user_id) as n, total from series_v),
    s as (select user_id, max(n) + 1 as points from p group by 1),
    k as (select user_id, points, unnest(range(points)) as k from s),
    m as (select user_id, points, k, sqrt(pow(sum(total * cos(2 * pi() * (k * n % points) / points)), 2)
                                        + pow(sum(total * sin(2 * pi() * (k * n % points) / points)), 2)) as size
          from k join p using (user_id) group by 1, 2, 3)
    select user_id, points, round(avg(size), 4) as mean, round(stddev_pop(size), 4) as std,
           round(max(size), 4) as max, round(min(size), 4) as min from m group by 1, 2""")
def series_spectrum(t):
    spectra = n.series_spectrum(t.series_v, "user_id", "hour", "total")
    return spectra.select(
        "user_id", "points", *[F.round(c, 4).alias(c) for c in ("mean", "std", "max", "min")]
    )


@plan("latency_percentiles", """
    select model, round(cast(sum(cast(latency_ms as decimal(18,9))) as double) / count(*), 9) as mean_ms,
           round(quantile_cont(latency_ms, 0.95), 9) as p95_ms
    from llm_requests_v group by 1""")
def latency_percentiles(t):
    out = m.latency_percentiles(t.llm_requests_v, "model", "latency_ms")
    return out.select("model", F.round("mean_ms", 9).alias("mean_ms"), F.round("p95_ms", 9).alias("p95_ms"))
