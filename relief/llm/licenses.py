"""License scan: a positional index of rare template words.

Every template word's inverse document frequency is counted over all files. The
index holds, for each template, the places of its highest-IDF words. A file's
occurrences of indexed words look up these postings; postings that agree on
file place minus template place line up, and the IDF weight that lines up best,
as a share of the template's indexed weight, is its coverage. A template counts
where half of it lines up and its mandatory key phrase stands in the file.
Beside that, fixed base phrases are located exactly.

All work is DataFrame operations. Each whole text is read once; what goes on is
only the places of template words.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lowered.
Defined results: null and empty texts have no words, empty label lists and score
0, and a null doc_id is returned as it is; equal rows are scanned each; on an
empty table the result is empty. Labels are joined by commas in sorted order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from relief.llm.urls import LOWER, UPPER
from relief.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: phrases that are located everywhere, with their labels
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# fixed values: label, words of the notice, mandatory key phrase
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)
# fixed values: words too common to tell licenses; kept only where a key phrase needs them
COMMON = ("the", "this", "is", "of", "to", "a", "and", "or", "in", "with", "for", "are", "any", "under", "2", "3", "4", "0")
RARE = 6  # indexed words of a template
SHARE = 0.5


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    """Template words that are not common, and all words of the phrases."""
    kept = {w for _, notice, _ in TEMPLATES for w in notice.split() if w not in COMMON}
    kept.update(w for _, _, key in TEMPLATES for w in key.split())
    kept.update(w for _, phrase in BASE for w in phrase.split())
    return sorted(kept)


def _hits(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Rows with a number, their count of words, and places of vocabulary words in order."""
    names = F.array(*(F.lit(w) for w in vocabulary()))
    places = F.filter(
        F.transform("_words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))),
        lambda h: h["word"].isin(vocabulary()),
    )
    none = F.array().cast("array<struct<pos:int,word:string>>")
    cut = docs.select(*keep, words_of(F.col(text)).alias("_words"))
    return materialise(
        cut.select(
            F.monotonically_increasing_id().alias("_row"),
            *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.when(F.arrays_overlap("_words", names), places).otherwise(none).alias("hits"),
        )
    )


def _phrase_places(phrase: str) -> Column:
    """Places at which the phrase's words stand one after the other."""
    words = phrase.split()

    def starts(hit: Column, at: Column) -> Column:
        fits = hit["word"] == words[0]
        for k, word in enumerate(words[1:], 1):
            other = F.get("hits", at + k)
            fits = fits & (other["word"] == word) & (other["pos"] == hit["pos"] + k)
        return F.coalesce(fits, F.lit(False))

    # every word of a phrase is in the vocabulary, so its places follow each other in `hits`
    return F.transform(F.filter("hits", starts), lambda h: h["pos"])


def _postings(rows: DataFrame) -> DataFrame:
    """(template, place, word, weight, share of its template's weight) of indexed words."""
    spark = rows.sparkSession
    files = rows.count()
    seen = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    entries = [
        (k, i, w)
        for k, (_, notice, _) in enumerate(TEMPLATES)
        for i, w in enumerate(notice.split())
        if w not in COMMON
    ]
    table = spark.createDataFrame(entries, "template int, place int, word string")
    found = seen.groupBy("word").agg(F.count(F.lit(1)).alias("files"))
    weighed = table.join(found, "word", "left").withColumn(
        "weight", F.log(1 + F.lit(float(files)) / (1 + F.coalesce("files", F.lit(0))))
    )
    rank = F.dense_rank().over(Window.partitionBy("template").orderBy(F.desc("weight"), "word"))
    indexed = weighed.withColumn("_rank", rank).where(F.col("_rank") <= RARE)
    total = F.sum("weight").over(Window.partitionBy("template"))
    return indexed.select("template", "place", "word", F.coalesce(F.try_divide("weight", total), F.lit(0.0)).alias("share"))


SPOTS = T.StructType(
    [T.StructField(n, t) for n, t in (("template", T.IntegerType()), ("place", T.IntegerType()), ("word", T.StringType()), ("share", T.DoubleType()))]
)


def scan(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Scan every text: kept columns, n_words, spots, base_labels, labels, score.

    `spots` lists label and first word of every base phrase found.
    """
    keep = list(keep)
    rows = _hits(docs, keep, text)
    # a few rows for each template, so this table is bounded by the templates
    postings = docs.sparkSession.createDataFrame(_postings(rows).collect(), SPOTS)
    lined = (
        rows.where(F.size("hits") > 0)
        .select("_row", F.explode("hits").alias("h"))
        .join(F.broadcast(postings), F.col("h.word") == F.col("word"))
        .groupBy("_row", "template", (F.col("h.pos") - F.col("place")).alias("shift"))
        .agg(F.sum("share").alias("share"))
        .groupBy("_row", "template")
        .agg(F.round(F.least(F.max("share"), F.lit(1.0)), 6).alias("share"))
        .where(F.col("share") >= SHARE)
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("template", "share"))).alias("_lined"))
    )

    def spots_of(label: str, phrase: str) -> Column:
        return F.transform(
            _phrase_places(phrase), lambda at: F.struct(F.lit(label).alias("label"), at.cast("long").alias("word"))
        )

    def share(k: int) -> Column:
        return F.when(F.size(_phrase_places(TEMPLATES[k][2])) > 0, F.get("_shares", F.lit(k)))

    out = (
        rows.join(lined, "_row", "left")
        .withColumn("spots", F.concat(*(spots_of(label, phrase) for label, phrase in BASE)))
        .withColumn("_shares", F.transform(F.sequence(F.lit(0), F.lit(len(TEMPLATES) - 1)), lambda k: F.element_at("_lined", k)))
        .withColumn("_base", F.transform("spots", lambda s: s["label"]))
    )
    by_method = F.array(*(F.when(share(k).isNotNull(), F.lit(t[0])) for k, t in enumerate(TEMPLATES)))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return out.select(
        *keep,
        "n_words",
        "spots",
        joined(F.col("_base")).alias("base_labels"),
        joined(F.array_compact(F.concat("_base", by_method))).alias("labels"),
        F.coalesce(F.greatest(*(share(k) for k in range(len(TEMPLATES)))), F.lit(0.0)).alias("score"),
    )
