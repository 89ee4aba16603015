"""Passage and labelled-block extraction from model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.functions.handles import handle_values, is_mentioned, parse_handles
from personaloom.functions.rows import compute_where
from personaloom.functions.text import strip_blanks

# The accepted label spellings of each content type, in output order.
LABELS = {
    "Social Media": [
        "Social Media", "Social", "Social Post", "Social Media Post", "Social Network",
        "Social Network Post",
    ],
    "Forum Post": [
        "Forum Post", "Forum", "Forum Message", "Forum Thread", "Discussion Forum",
        "Forum Discussion",
    ],
    "Online Review": [
        "Online Review", "Review", "Product Review", "Service Review", "Customer Review",
        "User Review",
    ],
    "Blog/News Article Comment": [
        "Blog/News Article Comment", "Blog Comment", "News Comment", "Article Comment", "Comment",
        "Reader Comment",
    ],
    "Online Ad": ["Online Ad", "Advertisement", "Promotion", "Marketing", "Promotional Content"],
}
CONTENT_TYPES = list(LABELS)
# The markers around a generated article.
ARTICLE_START = r"\[Synthetic Article\]"
ARTICLE_END = r"\[Real Person Text Usage Notes\]"

_SPELLINGS = [s for names in LABELS.values() for s in names]
BLOCK_PATTERN = r"\[(?:" + "|".join(_SPELLINGS) + r")\][^\[]*"
_PASSAGE_PATTERN = f"(?s){ARTICLE_START}(.*?){ARTICLE_END}"

PAIRS = "array<struct<ContentType:string,Text:string>>"
NAME_TYPES = ("Social Media", "Forum Post")


def base_type(label: Column) -> Column:
    """Content type of a label spelling; null for an unknown one. Case matters."""
    out = None
    for name, spellings in LABELS.items():
        hit = label.isin(spellings)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def passage(model_output: Column) -> Column:
    """Stripped text between the article markers; '' when there is none."""
    found = F.regexp_extract(model_output, _PASSAGE_PATTERN, 1)
    return F.coalesce(strip_blanks(found), F.lit(""))


def extract_passages(records: DataFrame, output: str = "model_output") -> DataFrame:
    """Add `generated_synthetic_passage` and drop the rows without one."""
    name = "generated_synthetic_passage"
    return compute_where(
        records, records.columns, {name: passage(F.col(output))}, lambda made: made[name] != ""
    )


def nest_passage_generation(records: DataFrame) -> DataFrame:
    """Move the generation columns and the passage under `SyntheticPassageGeneration`."""
    moved = ["system_prompt", "user_prompt", "model_parameters", "model_output"]
    inner = F.struct(*moved, "generated_synthetic_passage")
    return records.withColumn("SyntheticPassageGeneration", inner).drop(
        *moved, "generated_synthetic_passage"
    )


def raw_blocks(model_output: Column) -> Column:
    """Labelled blocks as ARRAY<STRUCT<ord, pos, ContentType, Text>>.

    A block runs to the next '[' or the end; blank blocks are left out. Order is
    content type first, position second.
    """
    def read(block, i):
        end = F.instr(block, "]")
        kind = base_type(F.substr(block, F.lit(2), end - F.lit(2)))
        ord_ = F.array_position(F.array(*[F.lit(t) for t in CONTENT_TYPES]), kind)
        return F.struct(
            ord_.cast("int").alias("ord"),
            i.alias("pos"),
            kind.alias("ContentType"),
            strip_blanks(F.substr(block, end + F.lit(1))).alias("Text"),
        )

    blocks = F.regexp_extract_all(model_output, F.lit(BLOCK_PATTERN), F.lit(0))
    return F.array_sort(F.filter(F.transform(blocks, read), lambda b: b["Text"] != ""))


def content_pairs(model_output: Column) -> Column:
    """Labelled blocks as ARRAY<STRUCT<ContentType, Text>>."""
    return F.transform(
        raw_blocks(model_output), lambda b: F.struct(b["ContentType"], b["Text"])
    )


def _with_text(pairs: Column, new_text) -> Column:
    return F.transform(
        pairs,
        lambda p: F.struct(p["ContentType"].alias("ContentType"), new_text(p).alias("Text")),
    )


def attribute_on_extraction(pairs: Column, handles: Column, first_name: Column) -> Column:
    """Prefix 'who : ' to social and forum texts that name neither a handle nor the first name.

    `who` is the first handle, or the first name where there is no handle.
    `handles` is the parsed map; pass it as a stored column, as it is read once per text.
    """
    values = handle_values(handles)
    who = F.coalesce(F.get(values, F.lit(0)), first_name)

    def new_text(p):
        bare = p["ContentType"].isin(*NAME_TYPES) & ~is_mentioned(p["Text"], values, first_name)
        return F.when(bare & who.isNotNull(), F.concat(who, F.lit(" : "), p["Text"])).otherwise(
            p["Text"]
        )

    return _with_text(pairs, new_text)


def attribute_on_repair(pairs: Column, handles: Column, first_name: Column) -> Column:
    """Prefix 'first-handle ' to every text that names nobody; nothing where there is no handle."""
    values = handle_values(handles)
    who = F.get(values, F.lit(0))

    def new_text(p):
        bare = ~is_mentioned(p["Text"], values, first_name) & who.isNotNull()
        return F.when(bare, F.concat(who, F.lit(" "), p["Text"])).otherwise(p["Text"])

    return _with_text(pairs, new_text)


def attribute_for_cohort(
    pairs: Column, handles: Column, first_name: Column, last_name: Column
) -> Column:
    """Without handles prefix 'First Last ' to every text; else 'first-handle ' to bare social texts."""
    values = handle_values(handles)
    who = F.get(values, F.lit(0))
    full_name = F.concat(first_name, F.lit(" "), last_name, F.lit(" "))

    def new_text(p):
        bare = (p["ContentType"] == "Social Media") & ~is_mentioned(p["Text"], values, first_name)
        return (
            F.when(F.size(handles) == 0, F.concat(full_name, p["Text"]))
            .when(bare & who.isNotNull(), F.concat(who, F.lit(" "), p["Text"]))
            .otherwise(p["Text"])
        )

    return _with_text(pairs, new_text)


def add_content_pairs(
    records: DataFrame,
    output: str = "model_output",
    handles: str = "social_media_handles",
    first_name: str = "first_name",
    profile_present: Column | None = None,
) -> DataFrame:
    """Extract the blocks of `output` and attribute them; adds `content_pairs`.

    Rows without output, or where `profile_present` is false, get null pairs and
    pass through unchanged.
    """
    usable = F.col(output).isNotNull()
    if profile_present is not None:
        usable = usable & F.coalesce(profile_present, F.lit(False))
    staged = records.withColumns(
        {
            "_handles": parse_handles(F.col(handles)),
            "_blocks": F.when(usable, content_pairs(F.col(output))),
        }
    )
    pairs = attribute_on_extraction(F.col("_blocks"), F.col("_handles"), F.col(first_name))
    return staged.withColumn("content_pairs", pairs).drop("_handles", "_blocks")
