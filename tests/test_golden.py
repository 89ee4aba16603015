"""Hand-written edge rows per operator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from personaloom.functions import draws, handles, text as tx
from personaloom.functions.entities import pattern_entities
from personaloom.operators import blocks, corpus, mentions, prompts, seeds, stats
from personaloom.operators.blocks import LABELS


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_blank_characters_are_those_of_python(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert {c for c in every if c.isspace()} == set(tx.BLANK_CHARS)
    texts = ["  a b \x1cc　", "", "\x85", "x", " \t y\nz "]
    assert column(spark, texts, tx.strip_blanks) == [t.strip() for t in texts]
    assert column(spark, texts, tx.word_count) == [len(t.split()) for t in texts]
    joined = "a".join(tx.BLANK_CHARS)
    assert column(spark, [joined], tx.word_count) == [len(joined.split())]


HANDLE_CASES = [
    ('{"Twitter": "@a", "Reddit": "@b"}', {"Twitter": ["@a"], "Reddit": ["@b"]}),
    ("{'Twitter': '@a'}", {"Twitter": ["@a"]}),
    ("{'Twitter': \"@o'brien\"}", {"Twitter": ["@o'brien"]}),
    ('{"Twitter": ["@a", "@b"], "X": "@c"}', {"Twitter": ["@a", "@b"], "X": ["@c"]}),
    ("{'Twitter': ['@a', '@b']}", {"Twitter": ["@a", "@b"]}),
    ("{'Twitter': None, 'X': '@c'}", {"X": ["@c"]}),
    ('{"X": "@1", "Y": "@2", "X": "@3"}', {"X": ["@3"], "Y": ["@2"]}),
    ("", {}),
    (None, {}),
    ("{}", {}),
    ("not a dict", {}),
]


def test_handles(spark):
    got = column(spark, [c[0] for c in HANDLE_CASES], handles.parse_handles)
    assert got == [c[1] for c in HANDLE_CASES]


def pairs_of(spark, text):
    return [(p["ContentType"], p["Text"]) for p in column(spark, [text], blocks.content_pairs)[0]]


def test_blocks(spark):
    assert pairs_of(spark, "[Comment]\n hi \n[Social] a [b] c\n[Forum]\r\n  \r\n[Poem] no [social media] no") == [
        ("Social Media", "a"),
        ("Blog/News Article Comment", "hi"),
    ]
    assert pairs_of(spark, "no label") == []
    assert pairs_of(spark, "[Review]") == []
    assert pairs_of(spark, "[Review]\nx\n") == [("Online Review", "x")]
    assert column(spark, [None], blocks.content_pairs) == [None]


def test_every_label_spelling(spark):
    for kind, names in LABELS.items():
        text = "".join(f"[{n}] t{i} " for i, n in enumerate(names))
        assert pairs_of(spark, text) == [(kind, f"t{i}") for i in range(len(names))]


def test_passages(spark):
    a, b = "[Synthetic Article]", "[Real Person Text Usage Notes]"
    texts = [f"{a} x {b}", f"{a} x", f"{a} \n {b}", f"{a}1{a}2{b}3{b}", None]
    assert column(spark, texts, blocks.passage) == ["x", "", "", f"1{a}2", ""]


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("extraction", ["@a : hello", "hello @A", "hello", "hi Ann"]),
        ("repair", ["@a hello", "hello @A", "@a hello", "hi Ann"]),
        ("cohort", ["@a hello", "hello @A", "hello", "hi Ann"]),
    ],
)
def test_attribution_modes(spark, mode, expected):
    pairs = [("Social Media", "hello"), ("Social Media", "hello @A"), ("Online Ad", "hello"), ("Forum Post", "hi Ann")]
    df = spark.createDataFrame(
        [("{'X': '@a'}", "ann", "Lee", pairs)],
        "h string, f string, l string, p array<struct<ContentType:string,Text:string>>",
    ).withColumn("m", handles.parse_handles(F.col("h")))
    p, m, f = F.col("p"), F.col("m"), F.col("f")
    made = {
        "extraction": lambda: blocks.attribute_on_extraction(p, m, f),
        "repair": lambda: blocks.attribute_on_repair(p, m, f),
        "cohort": lambda: blocks.attribute_for_cohort(p, m, f, F.col("l")),
    }[mode]()
    assert [x["Text"] for x in df.select(made.alias("x")).first()[0]] == expected


def test_attribution_without_handles(spark):
    pairs = [("Forum Post", "hello"), ("Online Ad", "hello")]
    df = spark.createDataFrame(
        [("{}", "Ann", "Lee", pairs)],
        "h string, f string, l string, p array<struct<ContentType:string,Text:string>>",
    ).withColumn("m", handles.parse_handles(F.col("h")))
    p, m, f = F.col("p"), F.col("m"), F.col("f")
    row = df.select(
        blocks.attribute_on_extraction(p, m, f).alias("a"),
        blocks.attribute_on_repair(p, m, f).alias("b"),
        blocks.attribute_for_cohort(p, m, f, F.col("l")).alias("c"),
    ).first()
    texts = [[x["Text"] for x in cell] for cell in row]
    assert texts == [["Ann : hello", "hello"], ["hello", "hello"], ["Ann Lee hello", "Ann Lee hello"]]


def test_numbers(spark):
    assert column(spark, ["$-12.5", "1.2.3", "", None, "₹1,000"], tx.money_value) == [12.5, 0.0, 0.0, 0.0, 1000.0]
    assert column(spark, ["35", "x", None], tx.int_or_zero) == [35, 0, 0]


def test_json_cells(spark):
    texts = ['a"b\t\n\\é/', "", None]
    cells = column(spark, texts, tx.json_cell)
    assert [json.loads(c) if c is not None else None for c in cells] == texts
    assert column(spark, cells, tx.decode_json_cell) == texts
    raw = ['"open', "35", "{'a': 1}", '"x"', "null", "NaN"]
    assert column(spark, raw, tx.decode_json_cell) == ['"open', "35", "{'a': 1}", "x", None, "NaN"]
    assert column(spark, ['"x"', '"open', None], tx.decode_json_cell_or_empty) == ["x", "", ""]


def test_entities(spark):
    text = "Ann Lee and Bob Ray: a.b@x.org, +1-555-010-9999, (555)010-9999, 123-45-6789, 12345-6789, 1234 5678 9012 3456"
    got = {(e["type"], e["value"]) for e in column(spark, [text], pattern_entities)[0]}
    assert {
        ("EMAIL", "a.b@x.org"), ("PHONE", "5550109999"), ("SSN", "123-45-6789"), ("ZIP_CODE", "12345-6789"),
        ("CREDIT_CARD", "1234 5678 9012 3456"), ("PERSON", "Ann Lee"), ("PERSON", "Bob Ray"),
    } <= got
    assert column(spark, [None, " "], pattern_entities) == [[], []]


def test_address_parts(spark):
    parts = column(spark, ["12 Oak Street, Mount Hill, Leeds"], mentions.address_parts)[0]
    assert parts == sorted(parts, key=lambda p: (-len(p), p))
    assert "leeds" in parts and "oak" in parts and not any("street" in p for p in parts)


def test_mention_gates(spark):
    values = ["7", "ab", "abc", "", "12"]
    assert column(spark, values, mentions.long_enough) == [True, False, True, False, True]


def tree(*nodes):
    return json.dumps(list(nodes))


def section(name, *parts):
    return {"type": "section", "name": name, "has_parts": list(parts)}


def par(value):
    return {"type": "paragraph", "value": value}


def sections_text(spark, text, target):
    df = spark.createDataFrame([(text,)], "v string")
    return df.select(seeds.section_text(F.col("v"), target)).first()[0]


def test_sections(spark):
    deep = tree(
        section("Personal life", par("a"), section("Home", par("skip")), par("b"), section("personal life 2", par("c"))),
        section("x", {"type": "list", "value": "no"}, section(" PERSONAL LIFE ", par("d"))),
        {"type": "section", "name": "Personal life", "has_parts": None},
    )
    assert sections_text(spark, deep, "Personal life") == "a\nb\nc\nd"
    assert sections_text(spark, "[]", "Personal life") == ""
    assert sections_text(spark, None, "Personal life") == ""


def test_sections_of_any_depth(spark):
    def nested(levels):
        node = section("personal life", par(f"x{levels}"), "odd", 3, None, {"has_parts": "no list"})
        for _ in range(levels):
            node = section('a [[[ \\" ]', "plain", node)
        return tree("text", node)

    rows = [(n, nested(n)) for n in (0, 3, 7, 8, 15, 16, 40)] + [(-1, None), (-2, "no json"), (-3, '"[[["')]
    df = spark.createDataFrame(rows, "n int, v string")
    found = df.select("n", seeds.section_text(F.col("v"), "personal life").alias("t"))
    assert {r.n: r.t for r in found.collect()} == {n: f"x{n}" if n >= 0 else "" for n, _ in rows}


def walked(node, target):
    """The wanted texts by plain recursion over parsed JSON."""
    out = []
    for part in node if isinstance(node, list) else []:
        if isinstance(part, dict):
            below = part.get("has_parts")
            if isinstance(part.get("name"), str) and target in part["name"].strip().lower() and isinstance(below, list):
                own = [p.get("value") for p in below if isinstance(p, dict) and p.get("type") == "paragraph"]
                out += [v for v in own if isinstance(v, str)]
            out += walked(below, target)
    return out


def test_sections_equal_recursion(spark):
    """Random trees of 1 to 30 levels with members in any order, odd parts, and names and texts that need escapes."""
    pick = random.Random(11)
    names = ["Personal life", " personal LIFE ii", "Early life", "Career", "p\u00e9rsonal life", 'a "]}" \\', "life", None, 7, ""]
    values = ["text", 'quote " and \\ and ] } [ {', "tab\t\nline", "", " blank ", "日本語 \u2028", None, "personal life", '\\"']

    def part(level):
        kind = pick.random()
        if kind < 0.35:
            made = {"type": pick.choice(["paragraph", "paragraph", "list"]), "value": pick.choice(values)}
        elif kind < 0.5:
            return pick.choice(["odd [[", 7, 1.5, True, None, ["x", [{"name": "Personal life", "has_parts": [{"type": "paragraph", "value": "no"}]}]]])
        else:
            made = {"type": "section", "name": pick.choice(names), "has_parts": parts(level - 1)}
            if pick.random() < 0.2:
                made["meta"] = {"name": "Early life", "has_parts": [{"type": "paragraph", "value": "hidden"}]}
            if pick.random() < 0.1:
                made["has_parts"] = pick.choice([None, "no list", {"a": []}])
        items = list(made.items())
        pick.shuffle(items)
        return dict(items)

    def parts(level):
        return [part(level) for _ in range(pick.randrange(1, 4))] if level > 0 else []

    trees = [parts(levels) for levels in [*range(1, 9)] * 8]
    for levels in (12, 20, 30):
        node = parts(3)
        for _ in range(levels):
            node = [{"has_parts": node, "name": pick.choice(names), "type": "section"}]
        trees.append(node)
    rows = [(i, json.dumps(t, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1)) for i, t in enumerate(trees)]
    df = spark.createDataFrame(rows, "n int, v string")
    wanted = {"personal": "Personal life", "early": "early LIFE", "any": "life", "odd": '"]}" \\'}
    texts = seeds.section_texts(F.col("v"), wanted)
    got = {r["n"]: [r[k] for k in wanted] for r in df.select("n", texts.alias("t")).select("n", "t.*").collect()}
    for n, tree_ in enumerate(trees):
        assert got[n] == ["\n".join(walked(tree_, t.lower())).strip() for t in wanted.values()]


def test_age_bands_fold_when_all_are_young(spark):
    def bands(oldest):
        df = spark.createDataFrame([(a, oldest) for a in (17, 18, 30, 59, 74, 75, 90) if a <= oldest], "a int, m int")
        return [r[0] for r in df.select(stats.age_band(F.col("a"), F.col("m"))).collect()]

    assert bands(90) == ["0-18", "19-30", "31-45", "46-60", "61-75", "75+", "75+"]
    assert bands(74) == ["0-18", "19-30", "31-45", "46-60", "61-75"]
    assert bands(59) == ["0-18", "19-30", "31-45", "46-60"]
    assert bands(58) == ["0-18", "19-30", "31-45"]


def test_inspiration_keeps_empty_lines(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None)], "a string, p string, e string")
    got = [r[0] for r in df.select(prompts.inspiration_text(F.col("a"), F.col("p"), F.col("e"))).collect()]
    assert got == ["a\n\nc", ""]


def test_outcome_counts(spark):
    rows = [("x", None, None), (None, "bad", None), (None, None, None), (None, None, "{")]
    df = spark.createDataFrame(rows, "model_output string, error string, line string")
    assert tuple(prompts.outcome_counts(df, bad_json="line").first()) == (1, 3, 1)


def test_as_string_record(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    row = corpus.as_string_record(df).first()
    assert (row["a"], row["b"], row["c"]) == ("1", "", "x")
    assert json.loads(row["complete_info"]) == {"a": 1, "b": None, "c": "x"}


def test_stable_uuid_form(spark):
    value = spark.range(1).select(draws.stable_uuid("s", F.col("id"))).first()[0]
    assert [len(p) for p in value.split("-")] == [8, 4, 4, 4, 12]
