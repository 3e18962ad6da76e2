"""Parts of messages as attachments: what is extracted, content addresses, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.scalars import INLINE_TYPES, MIME_EXTENSIONS, normalize_mime, path_of_hash

#: Fixed value: content shorter than this many characters stays inline.
MIN_CONTENT = 1024


def extraction_reason(ct: Column, data: Column, text: Column, disposition: Column) -> Column:
    """``extracted``, or why a part stays: content-type-filtered, unknown-type, no-data, too-small."""
    kind = normalize_mime(ct)
    content = F.coalesce(F.when(data != "", data), F.when((disposition == "attachment") & (text != ""), text))
    return (
        F.when(content.isNull(), "no-data").when(kind.isin(*INLINE_TYPES), "content-type-filtered").when(~F.coalesce(kind.isin(*MIME_EXTENSIONS), F.lit(False)), "unknown-type")
        .when(F.length(content) < MIN_CONTENT, "too-small").otherwise("extracted")
    )


def extraction_actions(parts: DataFrame, stored: DataFrame) -> DataFrame:
    """``parts`` (ct, data, text, cd) with hash and action of each: as ``extraction_reason``, and ``referenced`` where the content is stored already.

    Of equal contents within ``parts`` each counts as extracted; they share one address. ``stored``: hash.
    """
    acted = parts.withColumn("action", extraction_reason(F.col("ct"), F.col("data"), F.col("text"), F.col("cd")))
    content = F.coalesce(F.when(F.col("data") != "", F.col("data")), F.col("text"))
    hashed = acted.withColumn("hash", F.when(F.col("action") == "extracted", F.sha2(content, 256)))
    known = stored.select("hash").where("hash is not null").distinct().withColumn("is_stored", F.lit(True))
    joined = hashed.join(known, "hash", "left")
    return joined.withColumn("action", F.when(F.col("is_stored"), "referenced").otherwise(F.col("action"))).drop("is_stored")


def explode_parts(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per part with its place from 0; messages without parts give none."""
    return messages.select(*keep, F.posexplode("parts").alias("pos", "part")).select(*keep, "pos", "part.*")


def mark_extracted(parts: str, size: str = "size") -> Column:
    """The array of parts with the content of each replaced by its address and size, order kept."""
    return F.transform(parts, lambda p: p.withField("path", path_of_hash(F.sha2(p["data"], 256))).withField("original_size", F.octet_length(p["data"])).withField("data", F.lit(None).cast("string")))


def content_addresses(parts: DataFrame, content: str, *order: str) -> DataFrame:
    """hash, path and the first part (by order) of each distinct content, with its number of references.

    Minimum and count combine before the shuffle, so a content that a third of the parts hold costs its hash once a task.
    """
    first = F.min(F.struct(*order))
    counted = parts.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count(F.lit(1)).alias("references"), first.alias("first"))
    return counted.select("hash", "references", "first.*").withColumn("path", path_of_hash("hash"))


def reference_check(attachments: DataFrame, references: DataFrame) -> DataFrame:
    """hash, state: ``orphaned`` attachments nobody refers to and ``missing`` ones that are referred to; one full outer join."""
    a, r = attachments.select("hash").distinct().withColumn("stored", F.lit(True)), references.select("hash").distinct().withColumn("referred", F.lit(True))
    both = a.join(r, "hash", "full_outer")
    return both.where("stored is null or referred is null").select("hash", F.when(F.col("referred").isNull(), "orphaned").otherwise("missing").alias("state"))


def type_mismatches(attachments: DataFrame, references: DataFrame) -> DataFrame:
    """hash, declared, detected where the type that a reference declares isn't the type of the content."""
    joined = attachments.select("hash", "detected").join(references.select("hash", normalize_mime("ct").alias("declared")), "hash")
    return joined.where("detected <> declared").distinct()


def action_counts(parts: DataFrame) -> DataFrame:
    """ct and one column per action: how many parts of each type took which action."""
    actions = ["extracted", "referenced", "content-type-filtered", "unknown-type", "no-data", "too-small"]
    return parts.groupBy("ct").agg(*[F.count_if(F.col("action") == a).alias(a.replace("-", "_")) for a in actions])
