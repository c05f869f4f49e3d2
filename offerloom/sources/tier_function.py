"""Price tables of pages as a table function: a page in, its tiers out as rows.

``SELECT p.page_id, t.* FROM pages p, LATERAL price_tiers(p.html) t`` after :func:`register`. A page without tiers gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from . import html_tables

COLUMNS = "detector string, tax_excluded boolean, tier int, quantity bigint, price bigint, price_with_tax bigint"


class PriceTiers:
    """The tiers of one page in order of quantity, from the first detector that finds any. Tax is added, rounded half to even, where the page says it isn't included."""

    def eval(self, html: str) -> Iterator[tuple]:
        tiers, excluded, detector = html_tables.tiers_of(html)
        for i, (quantity, price) in enumerate(tiers.items()):
            yield detector, excluded, i, quantity, price, round(price * 11 / 10) if excluded else price


class DetectedTiers:
    """What each detector finds on a page by itself, whatever the others find: ``detector, quantity, price``."""

    def eval(self, html: str) -> Iterator[tuple]:
        for detector, found in html_tables.all_detectors(html):
            for quantity, price in found.items():
                yield detector, quantity, price


def register(spark: SparkSession) -> None:
    """``price_tiers(html)`` and ``detected_tiers(html)`` for SQL of this session."""
    spark.udtf.register("price_tiers", udtf(PriceTiers, returnType=COLUMNS))
    spark.udtf.register("detected_tiers", udtf(DetectedTiers, returnType="detector string, quantity bigint, price bigint"))


def tier_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row for each tier of each page: ``key`` and the columns of ``price_tiers``."""
    register(pages.sparkSession)
    return pages.sparkSession.sql(f"SELECT p.`{key}`, t.* FROM {{pages}} p, LATERAL price_tiers(p.`{html}`) t", pages=pages)


def detected_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    register(pages.sparkSession)
    return pages.sparkSession.sql(f"SELECT p.`{key}`, t.* FROM {{pages}} p, LATERAL detected_tiers(p.`{html}`) t", pages=pages)
