"""License texts in documents by diagonal voting.

Word k-grams of documents meet k-grams of templates in a Spark join. A hit at document word p and template word
t votes for diagonal p - t of that document and template. An unbroken copy puts all its votes on one diagonal;
words put in or left out shift the rest to a near one, so near diagonals are merged. Spans that gather enough
votes are then compared word by word in the document itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded
from personaloom.llm.storage import row_bytes, stored
from personaloom.llm.wordhash import ALNUM, list_column, words_of

K = 3
#: Words that two neighbouring diagonals of one copy may lie apart.
GAP = 4
#: Share of a long template's k-grams that must vote, and of its words that must be found again.
VOTES, COVER = 0.4, 0.7
BROADCAST_BYTES = 16_000_000
#: Base phrases and their labels (fixed values).
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Openings and notices of common licenses (fixed values); labels that start with `text:` are this method's own.
TEXTS = [
    ("text:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("text:apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("text:bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("text:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("text:cc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("text:gpl-line", "this work is licensed under the gnu general public license version 3"),
    ("text:mit-line", "released under the mit license"),
    ("text:cc-line", "licensed under cc by nc 4 0"),
    ("text:apache-line", "licensed under the apache license version 2 0"),
]


def templates(spark: SparkSession) -> DataFrame:
    """template (number), label, exact (a base phrase) and text."""
    rows = [(i, label, i < len(PHRASES), text) for i, (label, text) in enumerate([*PHRASES, *TEXTS])]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, text string")


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `grams`, the hashes of all rolling runs of K words."""
    for batch in bounded(batches, "text"):
        found = words_of(batch.column("text"), ALNUM)
        place, value = found.grams(K)
        counts = np.maximum(found.count() - K + 1, 0)
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*columns, list_column(value.view(np.int64), counts, pa.int64())], [*[c for c in batch.schema.names if c != "text"], "grams"])


def votes(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text), template, diagonal, n (votes), low and high (template words that voted).

    Rows of one id and text vote as one. The templates' k-grams are broadcast where they are small by a count
    of their bytes; a larger set is joined by a shuffle of both sides.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed.mapInArrow(_grams, f"doc_id {kind}, _text bigint, grams array<bigint>")
    rows = rows.select("doc_id", "_text", F.posexplode("grams").alias("place", "gram"))
    theirs = known.select("template", "text").mapInArrow(_grams, "template int, grams array<bigint>")
    theirs = theirs.select("template", F.posexplode("grams").alias("at", "gram"))
    if row_bytes(known, "text") * 8 <= BROADCAST_BYTES:
        theirs = F.broadcast(theirs)
    hits = rows.join(theirs, "gram").select("doc_id", "_text", "template", (F.col("place") - F.col("at")).alias("diagonal"), "at")
    return hits.groupBy("doc_id", "_text", "template", "diagonal").agg(
        F.count_distinct("at").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")
    )


def spans(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, _text, and `found`: template, first and last of the spans whose merged diagonals have enough votes.

    A base phrase needs all its k-grams on one diagonal. Other templates merge diagonals that lie at most GAP
    apart, one after the other in the document, and need a share of VOTES of their k-grams.
    """
    cast = votes(docs, known)
    sizes = known.withColumn("need", F.size(F.split("text", " ")) - (K - 1)).select("template", "exact", "need")
    cast = cast.join(F.broadcast(sizes), "template") if row_bytes(known) <= BROADCAST_BYTES else cast.join(sizes, "template")
    exact = cast.filter(F.col("exact") & (F.col("n") == F.col("need"))).select(
        "doc_id", "_text", "template", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("need") + K - 1).alias("last")
    )
    one = Window.partitionBy("doc_id", "_text", "template").orderBy("diagonal")
    loose = cast.filter(~F.col("exact")).withColumn(
        "_new", F.when(F.col("diagonal") - F.lag("diagonal").over(one) <= GAP, 0).otherwise(1)
    )
    loose = loose.withColumn("_run", F.sum("_new").over(one))
    merged = loose.groupBy("doc_id", "_text", "template", "_run", "need").agg(
        F.sum("n").alias("n"),
        F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high") + K).alias("last"),
    )
    merged = merged.filter(F.col("n") >= F.ceil(VOTES * F.col("need"))).select("doc_id", "_text", "template", "first", "last")
    every = exact.unionByName(merged)
    return every.groupBy("doc_id", "_text").agg(
        F.collect_set(F.struct("template", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))).alias("found")
    )


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and `spans`.

    `spans` holds each verified place: label, first and last word (end apart) and cover, the share of the
    template's words found in order. `score` is the largest cover, 0 without any. Labels are distinct, sorted
    and comma-joined; base phrases count as base labels at every place where their words stand consecutively.

    The found spans are few and reach the documents by a broadcast where a count of their bytes allows it, by a
    shuffle otherwise. Null and empty texts have no words. Repeated rows each get their result; other columns
    are left out.
    """
    known = templates(docs.sparkSession) if known is None else known
    cast = stored(spans(docs, known))
    size = cast.agg(F.coalesce(F.sum(F.size("found") * 16 + 48), F.lit(0)).alias("b")).first()["b"]
    listed = sorted((r.template, r.label, r.exact, r.text) for r in known.collect())
    verified = docs.sparkSession.sparkContext.broadcast({t: (label, exact, text.split(" ")) for t, label, exact, text in listed})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    cast = cast.withColumnRenamed("doc_id", "_id")
    both = F.broadcast(cast) if size <= broadcast_bytes else cast
    joined = keyed.join(both, keyed["doc_id"].eqNullSafe(both["_id"]) & (keyed["_text"] == both["_text"]), "left")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            text = words_of(batch.column("text"), ALNUM)
            counts = text.count().astype(np.int64)
            out = []
            for r, found in enumerate(batch.column("found").to_pylist()):
                places, base = [], []
                for f in found or ():
                    label, exact, wanted = verified.value[f["template"]]
                    a, b = max(0, f["first"]), min(int(counts[r]), f["last"])
                    there = [text.bytes_of(int(text.first[r]) + i).decode() for i in range(a, b)]
                    if exact:
                        cover = float(there == wanted)
                        base += [(a, label)] * int(cover)
                    else:
                        same = SequenceMatcher(None, wanted, there, autojunk=False)
                        cover = sum(m.size for m in same.get_matching_blocks()) / len(wanted)
                    if cover >= COVER:
                        places.append({"label": label, "first": a, "last": b, "cover": cover})
                places.sort(key=lambda x: (x["first"], x["last"], x["label"]))
                starts = [a for a, _ in base]
                out.append(
                    {
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted({x for _, x in base})),
                        "labels": ",".join(sorted({p["label"] for p in places})),
                        "score": max((p["cover"] for p in places), default=0.0),
                        "spans": places,
                    }
                )
            columns = [pa.array([o[c] for o in out], t) for c, t in _RESULT]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts), *columns], ["doc_id", "n_words", *(c for c, _ in _RESULT)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "found").mapInArrow(
        verify,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label:string,first:int,last:int,cover:double>>",
    )


_PLACE = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("cover", pa.float64())])
_RESULT = [
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", pa.list_(_PLACE)),
]
