"""First 30-days-past-due labels per horizon and a multinomial risk model on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import CORE_PREDICTORS, CUTOFF, ContractError
from loanspan.functions import months as M
from loanspan.functions.codes import true
from loanspan.functions.durable import durable

OUTCOMES = [0, 1, 2]
HORIZONS = [12, 24, 36, 60]
TRAIN_LAST_VINTAGE = 2022
PENALTY = 1.0


def first_overdue_ages(
    loans: DataFrame, performance: DataFrame, orig: DataFrame, cutoff: int = CUTOFF
) -> DataFrame:
    """Eligible loans with the age of their first report of at least one month past due."""
    first = (
        performance.filter(
            (F.col("reporting_period_num") <= cutoff) & (F.col("delinquency_num") >= 1)
        )
        .groupBy("loan_id")
        .agg(F.min("reporting_period_num").alias("first_overdue_month"))
    )
    payment = M.date_month_index(F.col("first_payment_month"))
    age = M.month_index(F.col("first_overdue_month")) - payment + 1
    return (
        loans.filter(true(F.col("survival_eligible")))
        .select("loan_id", "vintage_year", "duration_months", "event_type", *CORE_PREDICTORS)
        .join(first, "loan_id", "left")
        .join(orig.select("loan_id", "first_payment_month"), "loan_id", "left")
        .withColumn("first_30dpd_age", age)
        .drop("first_overdue_month", "first_payment_month")
    )


def horizon_labels(data: DataFrame, horizon: int) -> DataFrame:
    """`labels_by_horizon` of a single horizon."""
    return labels_by_horizon(data, [horizon]).drop("horizon_months")


def labels_by_horizon(data: DataFrame, horizons: list[int]) -> DataFrame:
    """`target` 0 overdue, 1 prepaid, 2 neither by each of the horizons, one row for each loan and
    `horizon_months`; loans that cannot be observed that long are left out.

    Overdue wins over prepayment of the same month.
    """
    duration, horizon = F.col("duration_months"), F.col("horizon_months")
    raw = F.col("first_30dpd_age")
    overdue = F.when((raw >= 1) & (raw <= duration), raw)
    prepay = F.when(F.col("event_type") == "PREPAYMENT", duration)
    by_overdue = overdue.isNotNull() & (overdue <= horizon) & (
        prepay.isNull() | (overdue <= prepay)
    )
    by_prepay = prepay.isNotNull() & (prepay <= horizon) & (overdue.isNull() | (prepay < overdue))
    observable = true(F.least(overdue, prepay) <= horizon) | true(duration >= horizon)
    each = F.explode(F.array(*[F.lit(h) for h in horizons]))
    return data.withColumn("horizon_months", each).filter(observable).withColumn(
        "target", F.when(true(by_overdue), 0).when(true(by_prepay), 1).otherwise(2)
    )


def class_counts(labelled: DataFrame, train_last: int = TRAIN_LAST_VINTAGE) -> DataFrame:
    """Loans of each horizon, half (training vintages or later ones) and outcome."""
    half = F.when(F.col("vintage_year") <= train_last, "train").otherwise("valid")
    return labelled.groupBy("horizon_months", half.alias("half"), "target").agg(
        F.count("*").alias("loans")
    )


def fit_outcome_models(
    data: DataFrame, horizons: list[int] = HORIZONS, train_last: int = TRAIN_LAST_VINTAGE
):
    """One model for each horizon; returns them by horizon and a table of hold-out metrics.

    The labelled rows of all horizons are written once, so loans are read and joined once however
    many horizons, stages and steps there are. Metrics carry the class counts of both halves. A
    horizon without all three outcomes in training, or without a later vintage, fails.
    """
    models, rows = {}, []
    with durable(_numeric(labels_by_horizon(data, horizons))) as table:
        counts = {}
        for r in class_counts(table, train_last).collect():
            counts[r["horizon_months"], r["half"], r["target"]] = r["loans"]
        for h in horizons:
            mine = {
                f"n_{half}_{k}": counts.get((h, half, k), 0) for half in ("train", "valid") for k in OUTCOMES
            }
            part = table.filter(F.col("horizon_months") == h)
            models[h], metrics = _fit(part, mine, train_last)
            rows.append({"horizon_months": h, **mine, **metrics})
    spark = data.sparkSession
    kinds = {int: "bigint", float: "double"}
    schema = ", ".join(
        f"{name} {'int' if name == 'horizon_months' else 'double' if name.startswith('auc') else kinds[type(v)]}"
        for name, v in rows[0].items()
    )
    return models, spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def _fit(labelled: DataFrame, counts: dict[str, int], train_last: int):
    """Median imputation with missing indicators, scaling and a multinomial logistic model.

    The penalty matches a summed loss with unit inverse strength.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    if not all(counts[f"n_train_{k}"] for k in OUTCOMES) or not any(counts[f"n_valid_{k}"] for k in OUTCOMES):
        raise ContractError("Training needs all three outcomes and a later vintage to validate on.")
    train = labelled.filter(F.col("vintage_year") <= train_last)
    missing = train.agg(*[F.count_if(F.isnan(c)).alias(c) for c in CORE_PREDICTORS]).first()
    # Only predictors with missing training values get an indicator.
    indicators = [f"missing_{c}" for c in CORE_PREDICTORS if missing[c]]
    filled = [f"filled_{c}" for c in CORE_PREDICTORS]
    n = sum(counts[f"n_train_{k}"] for k in OUTCOMES)
    stages = [
        Imputer(
            inputCols=CORE_PREDICTORS, outputCols=filled, strategy="median", relativeError=1e-4
        ),
        VectorAssembler(inputCols=filled + indicators, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            labelCol="target",
            family="multinomial",
            regParam=PENALTY / n,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=500,
            tol=1e-8,
        ),
    ]
    model = Pipeline(stages=stages).fit(train)
    return model, outcome_metrics(model.transform(labelled.filter(F.col("vintage_year") > train_last)))


def _numeric(data: DataFrame) -> DataFrame:
    """Double predictors with NaN for missing, plus missing indicators."""
    nan = F.lit(float("nan"))
    return data.select(
        "loan_id",
        "vintage_year",
        "horizon_months",
        F.col("target").cast("double").alias("target"),
        *[F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in CORE_PREDICTORS],
        *[F.col(c).isNull().cast("double").alias(f"missing_{c}") for c in CORE_PREDICTORS],
    )


def outcome_metrics(predicted: DataFrame) -> dict[str, float | None]:
    """Accuracy, log-loss, and one-vs-rest AUC and Brier score per outcome, from rows scored once."""
    from pyspark.ml.functions import vector_to_array

    rows = predicted.select(
        F.col("target").cast("int").alias("target"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
    )
    own = F.greatest(F.element_at("probability", F.col("target") + 1), F.lit(1e-15))
    with durable(rows) as scored:
        found = scored.agg(
            F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("accuracy"),
            (-F.avg(F.log(own))).alias("log_loss"),
            *[
                F.avg(
                    F.pow(
                        F.element_at("probability", k + 1) - (F.col("target") == k).cast("double"), 2
                    )
                ).alias(f"brier_{k}")
                for k in OUTCOMES
            ],
            *[F.count_if(F.col("target") == k).alias(f"has_{k}") for k in OUTCOMES],
            F.count("*").alias("rows"),
        ).first().asDict()
        n, has = found.pop("rows"), [found.pop(f"has_{k}") for k in OUTCOMES]
        return found | {f"auc_{k}": _auc(scored, k) if 0 < has[k] < n else None for k in OUTCOMES}


def _auc(rows: DataFrame, k: int) -> float:
    """One-vs-rest AUC from the binary evaluator's exact ROC points."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = rows.select(
        F.element_at("probability", k + 1).alias("score"),
        (F.col("target") == k).cast("double").alias("label"),
    )
    return BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(scored)
