"""Entities of seed texts that leak into generated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personaloom.functions.entities import (
    ENTITY_ARRAY,
    entities_json,
    overlapping,
    pattern_entities,
)
from personaloom.functions.rows import explode_once
from personaloom.functions.text import strip_blanks, text_or_empty


def text_entities(texts: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """Long table (keep..., type, value) of the distinct pattern entities of each text."""
    return texts.select(*keep, F.inline(pattern_entities(F.col(text))))


def with_model_entities(
    found: DataFrame, external: DataFrame, keep: tuple[str, ...]
) -> DataFrame:
    """Unite pattern entities with a table of model entities; values are stripped and distinct."""
    cols = [*keep, "type", "value"]
    other = external.withColumn("value", strip_blanks(F.col("value")))
    return found.select(*cols).unionByName(other.select(*cols)).distinct()


def _both_sides(records: DataFrame, real: str, synthetic: str) -> DataFrame:
    usable = (strip_blanks(text_or_empty(F.col(real))) != "") & (
        strip_blanks(text_or_empty(F.col(synthetic))) != ""
    )
    return records.filter(usable).withColumns(
        {
            "_real": pattern_entities(F.col(real)),
            "_synthetic": pattern_entities(F.col(synthetic)),
        }
    )


def _attach_external(records: DataFrame, external: DataFrame, id_col: str) -> DataFrame:
    """Add model entities (id, side, type, value) to both entity arrays."""
    entity = F.struct("type", strip_blanks(F.col("value")).alias("value"))
    sides = ("real", "synthetic")
    found = external.groupBy(id_col).agg(
        *[F.collect_set(F.when(F.col("side") == name, entity)).alias(f"_ext_{name}") for name in sides]
    )
    none = F.expr(f"cast(array() as {ENTITY_ARRAY})")
    out = records.join(found, id_col, "left").withColumns(
        {f"_{name}": F.array_union(f"_{name}", F.coalesce(f"_ext_{name}", none)) for name in sides}
    )
    return out.drop("_ext_real", "_ext_synthetic")


def contaminated_entities(
    records: DataFrame,
    id_col: str,
    real: str = "real_person_text_input",
    synthetic: str = "generated_synthetic_passage",
    external: DataFrame | None = None,
) -> DataFrame:
    """Records with both texts and an `_hits` array of seed entities found in the passage.

    Runs in-row. `external` adds model entities as a table
    (id_col, side 'real'|'synthetic', type, value), where id_col is unique in
    `records`; the entities of a record sit in its row, like its texts.
    """
    sides = _both_sides(records, real, synthetic)
    if external is not None:
        sides = _attach_external(sides, external, id_col)
    return sides.withColumn("_hits", overlapping(F.col("_real"), F.col("_synthetic")))


def contamination_report(
    records: DataFrame,
    id_col: str,
    real: str = "real_person_text_input",
    synthetic: str = "generated_synthetic_passage",
    external: DataFrame | None = None,
) -> DataFrame:
    """One row per contaminated value, with the record and both entity sets as JSON text."""
    columns = records.columns
    sides = contaminated_entities(records, id_col, real, synthetic, external)
    hits = explode_once(sides, "_hits", [*columns, "_real", "_synthetic"], "_hit")
    return hits.select(
        F.col(id_col).alias("unique_id"),
        F.col("_hit.type").alias("entity_type"),
        F.col("_hit.value").alias("entity_value"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("complete_record"),
        entities_json(F.col("_real")).alias("real_entities"),
        entities_json(F.col("_synthetic")).alias("synthetic_entities"),
    )


def contamination_summary(
    records: DataFrame,
    real: str = "real_person_text_input",
    synthetic: str = "generated_synthetic_passage",
) -> DataFrame:
    """Records, contaminated records and contaminations in one pass, without a shuffle of texts."""
    r, s = F.col(real), F.col(synthetic)
    usable = (strip_blanks(text_or_empty(r)) != "") & (strip_blanks(text_or_empty(s)) != "")
    hits = F.when(usable, F.size(overlapping(pattern_entities(r), pattern_entities(s))))
    n = F.coalesce(hits, F.lit(0))
    return records.select(n.alias("n")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("n") > 0).alias("contaminated_records"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("contaminations"),
    )


def drop_contaminated(records: DataFrame, report: DataFrame, id_col: str) -> DataFrame:
    """Records whose id is not in the report."""
    bad = report.select(F.col("unique_id").alias(id_col)).distinct()
    return records.join(bad, id_col, "left_anti")


def keep_clean(
    records: DataFrame,
    real: str = "real_person_text_input",
    synthetic: str = "generated_synthetic_passage",
) -> DataFrame:
    """Drop contaminated records in-row, without a report or a join; records lacking a text are clean."""
    r, s = F.col(real), F.col(synthetic)
    return records.filter(
        F.coalesce(F.size(overlapping(pattern_entities(r), pattern_entities(s))), F.lit(0)) == 0
    )
