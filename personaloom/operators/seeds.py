"""Seed-person selection from structured encyclopaedia records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.functions.text import json_cell, strip_blanks

# Names the selection looks for, all compared in lower case.
PERSON_INFOBOX = "infobox person"
BORN_PART = "born"
PERSONAL_SECTION = "personal life"
EARLY_SECTION = "early life"

INFOBOXES = "array<struct<name:string,has_parts:array<struct<name:string,value:string>>>>"


def has_person_infobox(infoboxes: Column) -> Column:
    """True where some infobox is named exactly 'infobox person', in any case; null lists fail."""
    found = F.exists(infoboxes, lambda b: F.lower(b["name"]) == PERSON_INFOBOX)
    return F.coalesce(found, F.lit(False))


def birth_origin(infoboxes: Column) -> Column:
    """Value of the first part named 'born' in a person infobox; '' when there is none."""
    persons = F.filter(infoboxes, lambda b: F.lower(b["name"]) == PERSON_INFOBOX)
    parts = F.flatten(
        F.transform(persons, lambda b: F.coalesce(b["has_parts"], F.array().cast(_PARTS)))
    )
    born = F.filter(parts, lambda p: F.lower(p["name"]) == BORN_PART)
    return F.coalesce(F.get(born, F.lit(0))["value"], F.lit(""))


_PARTS = "array<struct<name:string,value:string>>"


# JSON read as tokens: a string (with the colon behind it, if it is a key), a bracket, or a number or word.
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[\[\]{}]|[^\s\[\]{}:,"]++'
_FOUND = "array<struct<target:int,value:string>>"
_NODE = f"struct<name:string,kind:string,value:string,own:array<string>,found:{_FOUND}>"
# skip: open brackets that lead nowhere; listed: the place is in a list of parts, not among a part's members
_PLACE = f"struct<skip:int,listed:boolean,key:string,nodes:array<{_NODE}>,found:{_FOUND}>"


def _changed(state: Column, **fields) -> Column:
    names = ("skip", "listed", "key", "nodes", "found")
    return F.struct(*[fields.get(n, state[n]).alias(n) for n in names])


def _scalar(token: Column) -> Column:
    """The text of a JSON string, number or boolean; null stays null."""
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def _closed(state: Column, targets: list[str]) -> Column:
    """The state behind a part's end: what it holds goes to the part around it."""
    nodes = state["nodes"]
    node, outer = F.try_element_at(nodes, F.lit(-1)), F.try_element_at(nodes, F.lit(-2))
    name = F.lower(strip_blanks(node["name"]))

    def for_target(i: int, target: str) -> Column:
        texts = F.transform(node["own"], lambda v: F.struct(F.lit(i).alias("target"), v.alias("value")))
        return F.when(F.contains(name, F.lit(target.lower())), texts)

    own = [for_target(i, t) for i, t in enumerate(targets)]
    nothing = F.array().cast(_FOUND)
    found = F.concat(*[F.coalesce(o, nothing) for o in own], node["found"])
    paragraph = (node["kind"] == "paragraph") & node["value"].isNotNull() & (node["value"] != "null")
    around = F.struct(
        outer["name"].alias("name"),
        outer["kind"].alias("kind"),
        outer["value"].alias("value"),
        F.when(paragraph, F.concat(outer["own"], F.array(node["value"]))).otherwise(outer["own"]).alias("own"),
        F.concat(outer["found"], found).alias("found"),
    )
    at_root = F.size(nodes) == 1
    rest = F.concat(F.slice(nodes, F.lit(1), F.greatest(F.size(nodes) - 2, F.lit(0))), F.array(around))
    return _changed(
        state,
        listed=F.lit(True),
        nodes=F.when(at_root, F.array().cast(f"array<{_NODE}>")).otherwise(rest),
        found=F.when(at_root, F.concat(state["found"], found)).otherwise(state["found"]),
    )


def _with_member(state: Column, token: Column) -> Column:
    """The state behind a member's plain value; only name, type and value are kept, the value as it is written."""
    nodes, key = state["nodes"], state["key"]
    node = F.try_element_at(nodes, F.lit(-1))
    changed = F.struct(
        F.when(key == "name", _scalar(token)).otherwise(node["name"]).alias("name"),
        F.when(key == "type", _scalar(token)).otherwise(node["kind"]).alias("kind"),
        F.when(key == "value", token).otherwise(node["value"]).alias("value"),
        node["own"].alias("own"),
        node["found"].alias("found"),
    )
    kept = F.concat(F.slice(nodes, F.lit(1), F.size(nodes) - 1), F.array(changed))
    return F.when(key.isin("name", "type", "value"), _changed(state, nodes=kept)).otherwise(state)


def section_texts(sections: Column, targets: dict[str, str]) -> Column:
    """A struct of texts by name: for each target those of all sections whose name contains it, in document order.

    `sections` is JSON text, nested to any depth. A matching section gives its own direct paragraphs, then its
    sub-sections are searched as well; one without paragraphs gives nothing. Parts of any other shape hold
    nothing and hide nothing; text that is no JSON list, and null, give ''.

    One fold over the tokens finds all targets. Its state is a stack with a node for each part that is open, so
    it is as deep as the record and no deeper; a part's name is compared where the part ends, as members come in any
    order. Texts that hold no target in any spelling are not read.
    """
    wanted = list(targets.values())
    node = F.struct(*[F.lit(None).alias(n) for n in ("name", "kind", "value")], F.array().alias("own"), F.array().alias("found"))
    start = F.struct(F.lit(0), F.lit(False), F.lit(None), F.array(), F.array()).cast(_PLACE)

    def step(state, token):
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        deeper = F.when(opens, 1).when(closes, -1).otherwise(0)
        begun = F.concat(state["nodes"], F.array(node.cast(_NODE)))
        is_key = F.startswith(token, F.lit('"')) & F.endswith(token, F.lit(":"))
        in_list = (
            F.when(token == "{", _changed(state, listed=F.lit(False), key=F.lit(None).cast("string"), nodes=begun))
            .when(token == "[", _changed(state, skip=F.lit(1)))
            .when(token == "]", _changed(state, listed=F.lit(False)))
            .otherwise(state)
        )
        in_part = (
            F.when(is_key, _changed(state, key=_scalar(F.rtrim(F.rtrim(token, F.lit(":"))))))
            .when((token == "[") & (state["key"] == "has_parts"), _changed(state, listed=F.lit(True)))
            .when(opens, _changed(state, skip=F.lit(1)))
            .when(token == "}", _closed(state, wanted))
            .otherwise(_with_member(state, token))
        )
        at_root = F.when(token == "[", _changed(state, listed=F.lit(True))).otherwise(state)
        moved = F.when(state["listed"], in_list).when(F.size(state["nodes"]) == 0, at_root).otherwise(in_part)
        # the cast drops what the branches say about nulls, which differs
        return F.when(state["skip"] > 0, _changed(state, skip=state["skip"] + deeper)).otherwise(moved).cast(_PLACE)

    def texts(state):
        def text(i):
            mine = F.transform(F.filter(state["found"], lambda f: f["target"] == i), lambda f: _scalar(f["value"]))
            return strip_blanks(F.array_join(mine, "\n"))

        return F.struct(*[text(i).alias(n) for i, n in enumerate(targets)])

    is_list = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(sections)), F.lit("ARRAY")), F.lit(False))
    read = is_list
    if all(t.isascii() and t.replace(" ", "").isalnum() for t in wanted):  # no other spelling but by \u
        low = F.lower(sections)
        spelt = [F.contains(low, F.lit(t.lower())) for t in wanted]
        read = F.coalesce(F.contains(sections, F.lit("\\u")), F.lit(False))
        for one in spelt:
            read = read | F.coalesce(one, F.lit(False))
        read = read & is_list
    tokens = F.when(read, F.regexp_extract_all(sections, F.lit(_TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(tokens, start, step, texts)


def section_text(sections: Column, target: str) -> Column:
    """Text of all sections whose name contains `target`; see `section_texts`."""
    return section_texts(sections, {"text": target})["text"]


def select_seed_people(
    records: DataFrame,
    keep: tuple[str, ...] = (),
    sections: str = "sections",
    infoboxes: str = "infoboxes",
) -> DataFrame:
    """People with a name, a person infobox and a personal- or early-life text.

    `sections` holds JSON text of any depth. The cheap tests run before it is
    read. Adds the columns personal_life and early_life; `keep` names columns
    to carry. Row-local: no job runs ahead, nothing is stored or shuffled.
    """
    people = records.filter(
        has_person_infobox(F.col(infoboxes)) & (F.coalesce(F.col("name"), F.lit("")) != "")
    )
    texts = section_texts(F.col(sections), {"personal_life": PERSONAL_SECTION, "early_life": EARLY_SECTION})
    wanted = F.filter(F.array(texts), lambda x: (x["personal_life"] != "") | (x["early_life"] != ""))
    return people.select(
        *keep, "name", "url", "abstract", F.col(sections).alias("wikipedia_content"), F.inline(wanted)
    )


def seed_cells(seeds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The six output columns with string cells JSON-quoted; section JSON is written as it is."""
    quoted = {"Name": "name", "URL": "url", "Abstract": "abstract"}
    texts = {"Personal_Life": "personal_life", "Early_Life": "early_life"}
    return seeds.select(
        *keep,
        *[json_cell(F.col(c)).alias(n) for n, c in quoted.items()],
        F.col("wikipedia_content").alias("Wikipedia_Content"),
        *[json_cell(F.col(c)).alias(n) for n, c in texts.items()],
    )
