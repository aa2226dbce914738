"""Whole JSON bodies on their way out: every string and member name masked, protocol strings left alone or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters, mask
from .detect import detect
from .wire import rewrite


def mask_bodies(bodies: DataFrame, mode: str = "placeholder", key: str = "", profile: str = "BALANCED") -> tuple[DataFrame, DataFrame]:
    """(``bodies`` plus ``rewritten``, vault) for bodies (request_id, scope_id, body).

    All strings are taken for a user's text, and so are member names; names that become equal are
    told apart by a number. A string that a protocol needs must not change: a finding in it, or a
    form that its protocol does not have, refuses the body (null).
    """
    vaults = []

    def change(leaves: DataFrame) -> DataFrame:
        rows, vault = mask.mask(detect(leaves, "text", profile=profile), mode, key)
        vaults.append(vault)
        fits = adapters.protocol_form(F.col("keys"), F.col("text"))
        bad = (F.col("kind") == "string") & fits.isNotNull() & (~F.coalesce(fits, F.lit(True)) | (F.col("masked") != F.col("text")))
        return rows.withColumn("refused", bad).withColumnRenamed("masked", "new")

    return rewrite(bodies, change, carry=("scope_id",), names=True), vaults[0]
