"""Evidence from billing records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.functions.text import has_any, lowered, named
from posture.operators.evidence import Distinct, Pass, Rows, Top, Total
from posture.operators.run import Run
from posture.plans.passes import evidence

USAGE = "billing.usage"


def _sku() -> Column:
    return lowered(F.col("sku_name"))


def _serverless() -> Column:
    """The record's own flag, and only without one the SKU name."""
    return F.coalesce(F.col("product_features.is_serverless"), _sku().contains("serverless"))


@evidence("usage", USAGE)
def usage(run: Run) -> Pass:
    """One scan of the billing records, over the lookback and the trend periods.

    Sums are taken per day and product first: few groups, whatever the number of
    records. Serverless jobs are a spread key of the same scan.
    """
    trend = fixed.TREND_DAYS
    widest = max(run.config.lookback_days, 2 * trend)
    frame = run.recent(USAGE, "usage_date", widest)
    recent = F.lit(True)
    if run.config.lookback_days < widest:
        recent = run.since(frame, "usage_date")
    in_trend = run.since(frame, "usage_date", 2 * trend)
    in_last = run.since(frame, "usage_date", trend)
    amount = F.col("usage_quantity")
    photon = F.coalesce(F.col("product_features.is_photon"), F.lit(False))
    product = lowered(F.col("billing_origin_product"))
    sql_sku = _sku().contains("sql")
    other_than_sql = ~named(product, run.config.sql_products)
    tag_keys = F.map_keys(F.col("custom_tags"))
    chargeback = F.exists(
        tag_keys, lambda key: has_any(F.lower(key), fixed.CHARGEBACK_TAGS)
    )

    def amount_where(condition: Column) -> Total:
        return Total(F.when(recent & condition, amount).otherwise(0))

    return Pass(
        frame,
        {
            "usage.rows": Rows(recent),
            "usage.days": Distinct("usage_date", recent),
            "usage.total": amount_where(F.lit(True)),
            "usage.serverless": amount_where(_serverless()),
            "usage.serverless_products": Distinct(
                "billing_origin_product", recent & F.col("product_features.is_serverless")
            ),
            "usage.serverless_jobs": Distinct("job", recent & _serverless()),
            "usage.photon": amount_where(photon),
            "usage.sql": amount_where(sql_sku),
            "usage.vectorized": amount_where(photon | _sku().contains("photon") | sql_sku),
            "usage.non_sql": amount_where(other_than_sql),
            "usage.all_purpose": amount_where(other_than_sql & _sku().like("%all_purpose%")),
            "usage.gpu": amount_where(_sku().contains("gpu")),
            "usage.tagged": Rows(recent & (F.size(tag_keys) > 0)),
            "usage.chargeback": Rows(recent & chargeback),
            "usage.tag_keys": Top("tag_key", 8, recent),
            "usage.egress": Rows(
                recent & (has_any(_sku(), fixed.EGRESS_SKUS) | product.contains("sharing"))
            ),
            "usage.trend_days": Distinct("usage_date", in_trend),
            "usage.last_period": Total(F.when(in_last, amount).otherwise(0)),
            "usage.prior_period": Total(F.when(in_trend & ~in_last, amount).otherwise(0)),
        },
        carrier=("usage_date", "billing_origin_product"),
        spread={"job": F.col("usage_metadata.job_id")},
        # Records carry one of few sets of tag keys, which are taken apart after grouping.
        keys={"tag_key": tag_keys},
    )
