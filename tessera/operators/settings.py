"""Settings of detectors in layers: what a request says goes before a file, and a file before the registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Names of an options file that switch parts on and set their thresholds.
ENABLED, SURE = "enabled_parts.", "confidence."


def layered(layers: Sequence[DataFrame], keys: Sequence[str] = ("name",)) -> DataFrame:
    """(keys, value, layer) of (keys, value): for each key the value of the first layer that has one; a null is none.

    Within a layer the smallest value of a repeated key stands.
    """
    rows = None
    for k, layer in enumerate(layers):
        one = layer.where("value IS NOT NULL").select(*keys, F.struct(F.lit(k).alias("layer"), "value").alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*keys).agg(F.min("v").alias("v")).select(*keys, "v.value", "v.layer")


def file_parts(options: DataFrame) -> DataFrame:
    """(part, enabled, conf) that an options file (name, value) sets; null where it says nothing or no number."""
    of = lambda prefix: F.when(F.col("name").startswith(prefix), F.substring(F.col("name"), F.lit(len(prefix) + 1), F.length("name")))
    part = F.coalesce(of(ENABLED), of(SURE))
    switch = F.max(F.when(F.col("name").startswith(ENABLED) & F.col("value").isNotNull(), text.truthy(F.col("value"))))
    sure = F.max(F.when(F.col("name").startswith(SURE), F.col("value").try_cast("double")))
    return options.withColumn("part", part).where("part IS NOT NULL").groupBy("part").agg(switch.alias("enabled"), sure.alias("conf"))


def part_settings(requests: DataFrame, options: DataFrame, registry: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(request, part, type, enabled, conf, enabled_by, conf_by): every registered part as a request has it.

    ``requests`` (request, parts, confidence): a list of parts, by name or alias, says alone what is on; a null one
    leaves it to the file's options (name, value) and then to ``registry`` (part, type, enabled, conf).
    Confidences go by part: request, file, registry. Names that are not registered count for nothing. The
    registry has a row a detector, some tens, and travels as one.
    """
    own = registry.alias("r").join(file_parts(options).alias("f"), "part", "left")
    pick = lambda c: (F.coalesce(f"f.{c}", f"r.{c}").alias(c), F.when(F.col(f"f.{c}").isNotNull(), "file").otherwise("default").alias(f"{c}_by"))
    base = own.select("part", "r.type", *pick("enabled"), *pick("conf"))
    whole = base.agg(F.sort_array(F.collect_list(F.struct(*base.columns))).alias("parts_known")).withColumn("_one", F.lit(1))
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    plain = lambda p: F.coalesce(named[p], p) if named is not None else p
    asked = requests.select("request", F.transform("parts", plain).alias("parts"), "confidence", F.lit(1).alias("_one"))
    rows = asked.join(F.broadcast(whole), "_one").select("request", "parts", "confidence", F.explode("parts_known").alias("k"))
    listed: Column = F.col("parts").isNotNull()
    sure = F.col("confidence")[F.col("k.part")]
    return rows.select(
        "request", "k.part", "k.type",
        F.when(listed, F.coalesce(F.array_contains("parts", F.col("k.part")), F.lit(False))).otherwise(F.col("k.enabled")).alias("enabled"),
        F.coalesce(sure, "k.conf").alias("conf"),
        F.when(listed, "request").otherwise(F.col("k.enabled_by")).alias("enabled_by"),
        F.when(sure.isNotNull(), "request").otherwise(F.col("k.conf_by")).alias("conf_by"),
    )
