"""License passages by diagonal voting on rolling word k-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizlake.llm.columns import lower_ascii, text_of

# The base phrases and their labels.
BASE = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
# Wording of public licenses and their usual notices.
PASSAGES = [
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "mit",
    ),
    (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software",
        "mit",
    ),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2.0",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
]
# Words too common to point at a license; a k-gram of these alone casts no vote.
COMMON = (
    "a all an and any are as at be by can for in is it not of on or that the this to under with without you may".split()
)
K = 2
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 3


def template_table(spark: SparkSession) -> DataFrame:
    """A row per voting template position; its size is fixed by the lists above.

    Every base phrase is a template of its own, so its places come from the same votes.
    Templates have fewer than 64 positions, so a diagonal's votes fit the bits of a long.
    """
    rows = []
    for number, (phrase, label) in enumerate(BASE + PASSAGES):
        words = phrase.split()
        base = number < len(BASE)
        voting = [p for p in range(len(words) - K + 1) if not set(words[p : p + K]) <= set(COMMON)]
        rows += [(number, base, label, words, p, words[p : p + K], len(voting)) for p in voting]
    schema = (
        "template int, base boolean, label string, phrase array<string>, position int, gram array<string>, n_voting int"
    )
    table = spark.createDataFrame(rows, schema)
    return table.withColumn("hash", _hash([F.get("gram", F.lit(i)) for i in range(K)])).drop("gram")


def _hash(words):
    return F.xxhash64(*words)


def _words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = text_of(text)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(raw).alias("mark"),
        F.filter(F.split(lower_ascii(raw), WORD_BREAK, -1), lambda word: word != "").alias("words"),
    )


def license_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = 0.6, gap: int = GAP
) -> DataFrame:
    """Verified license spans: doc_id, mark, base, label, first_word, last_word, coverage.

    Every rolling k-gram hash of every document meets the template positions (a join with a
    table of fixed size). A hit's diagonal is its place in the document less its place in the
    template; hits on one diagonal are gathered as a set of template positions, which repeated
    rows of a document leave as it is. Diagonals at most ``gap`` apart are merged, so a few
    words put in or left out do not split a passage. Last, the words themselves are compared
    on the merged diagonals. Base phrases must stand whole on one diagonal.
    """
    spark = docs.sparkSession
    templates = template_table(spark)
    fixed = F.broadcast(templates.select("hash", "template", "position", "n_voting", "base"))
    rows = _words(docs, doc_id, text)
    gram = lambda start: _hash([F.get(F.col("words"), start + i) for i in range(K)])
    grams = rows.filter(F.size("words") >= K).select(
        "doc_id", "mark", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - K), gram)).alias("place", "hash")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position"))
    diagonals = (
        grams.join(fixed, "hash")
        .groupBy("doc_id", "mark", "template", "base", "n_voting", (F.col("place") - F.col("position")).alias("diagonal"))
        .agg(F.bit_or(bit).alias("hits"))
        .filter(~F.col("base") | (F.bit_count("hits") == F.col("n_voting")))
    )
    along = W.partitionBy("doc_id", "mark", "template", "base", "n_voting").orderBy("diagonal")
    merged = (
        diagonals.withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > gap), F.lit(True)))
        .withColumn("fresh", F.col("fresh") | F.col("base"))
        .withColumn("run", F.sum(F.col("fresh").cast("int")).over(along))
        .groupBy("doc_id", "mark", "template", "n_voting", "run")
        .agg(
            F.min("diagonal").alias("low"),
            F.max("diagonal").alias("high"),
            F.bit_or("hits").alias("hits"),
        )
        .filter(F.bit_count("hits") >= F.col("n_voting") * coverage)
        .select("doc_id", "mark", "template", "low", "high")
    )
    # Only a document with a word that no common list holds can have a span, so only those move.
    telling = sorted({word for phrase, _ in BASE + PASSAGES for word in phrase.split()} - set(COMMON))
    holders = rows.filter(F.arrays_overlap("words", F.array(*[F.lit(word) for word in telling])))
    phrases = F.broadcast(templates.select("template", "base", "label", "phrase").dropDuplicates(["template"]))
    spans = holders.dropDuplicates(["doc_id", "mark"]).withColumnsRenamed({"doc_id": "own_id", "mark": "own_mark"}).join(
        merged, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark"))
    )
    spans = spans.join(phrases, "template")
    same = lambda word, position: F.exists(
        F.sequence(F.col("low"), F.col("high")),
        lambda diagonal: (diagonal + position >= 0)
        & F.coalesce(F.get(F.col("words"), diagonal + position) == word, F.lit(False)),
    )
    matched = F.aggregate(
        F.transform("phrase", lambda word, position: same(word, position).cast("int")), F.lit(0), lambda a, b: a + b
    )
    verified = (
        spans.withColumn("coverage", matched / F.size("phrase"))
        .filter(F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(coverage))
        .select("doc_id", "mark", "base", "label", F.greatest("low", F.lit(0)).alias("first_word"),
                (F.col("high") + F.size("phrase") - 1).alias("last_word"), "coverage")
    )
    # Where several passages claim one place, the best covered ones have it.
    near = W.partitionBy("doc_id", "mark", "base").orderBy("first_word").rangeBetween(-gap, gap)
    rivals = verified.withColumn("best", F.max("coverage").over(near))
    return rivals.filter(F.col("base") | (F.col("coverage") == F.col("best"))).drop("best")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_words, the places of base phrases, labels of base phrases and of passages.

    Null texts count as empty. Documents without a span have n_base 0, null places, empty
    labels and score 0. The score is the best coverage of any span. Rows of one id and text
    get equal results. An empty table gives no rows.
    """
    spans = license_spans(docs, doc_id, text)
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    found = (
        spans.groupBy("doc_id", "mark")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
            F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            F.collect_set("label").alias("labels"),
            F.max("coverage").alias("score"),
        )
        .withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    )
    rows = _words(docs, doc_id, text).select("doc_id", "mark", F.size("words").cast("long").alias("n_words"))
    return rows.join(
        found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left"
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(joined(F.col("base_labels")), F.lit("")).alias("base_labels"),
        F.coalesce(joined(F.col("labels")), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
