"""The one evaluation on the locked test set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.functions import ordinal
from bagspark.operators.metrics import bootstrap_qwk_ci, ensemble_predict, grading_metrics
from bagspark.operators.splits import SplitError, fingerprint


def evaluate_locked(
    model_cums: DataFrame,
    splits: DataFrame,
    unlock: bool = False,
    bootstrap: int = 2000,
    n_classes: int = 3,
    method: str = "multinomial",
) -> DataFrame:
    """One row: metrics of the ensemble on test patients, spread, fingerprint and kappa interval.

    ``model_cums`` holds (patient_id, model, cumulative). Refuses to run without ``unlock=True``. ``method`` is that of the bootstrap.
    """
    if not unlock:
        raise SplitError("the test set is locked; pass unlock=True once model selection is over")
    truth = splits.where("is_test").select("patient_id", F.col("label").alias("y_true"))
    test = model_cums.join(truth.select("patient_id"), "patient_id", "left_semi")
    preds = ensemble_predict(test, n_classes, key="patient_id").join(truth, "patient_id")
    preds = preds.withColumn("y_pred", ordinal.corn_predict("cumulative", n_classes=n_classes))
    one = F.lit(1).alias("_one")
    row = grading_metrics(preds, n_classes).select("*", one)
    extra = preds.agg(F.avg("spread_samp").alias("mean_spread"), F.max("n_models").alias("n_models"), one)
    out = row.join(extra, "_one").join(fingerprint(splits).select("*", one), "_one")
    if bootstrap:
        out = out.join(bootstrap_qwk_ci(preds, bootstrap, n_classes=n_classes, method=method).select("*", one), "_one")
    return out.drop("_one")
