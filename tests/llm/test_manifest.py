"""The Merkle manifest against plain Python: every tree size, odd rows, altered rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quizlake.llm import merkle
from quizlake.llm.columns import lower_ascii

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def record(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold_up(leaves):
    """The root, and per leaf what stands before and behind it on each level."""
    paths, nodes, span = [[] for _ in leaves], leaves, 1
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            place = i // span
            run = place // 8 * 8
            path.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
        nodes, span = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], span * 8
    return nodes[0], paths


def expected(rows, altered):
    trees = defaultdict(list)
    for row in rows:
        leaf = record([row[f] for f in FIELDS])
        trees[row["lang"]].append(((row["doc_id"] is not None, row["doc_id"] or 0), leaf, row))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {lang: fold_up([leaf for _, leaf, _ in sorted(trees[lang], key=lambda t: t[:2])]) for lang in order}
    root, above = fold_up([built[lang][0] for lang in order]) if order else (None, [])
    out = []
    for lang, upper in zip(order, above):
        subroot, paths = built[lang]
        for (_, leaf, row), path in zip(sorted(trees[lang], key=lambda t: t[:2]), paths):
            steps = path + upper
            folded = record([altered(row) if f == "text" else row[f] for f in FIELDS])
            for before, after in steps:
                folded = sha(before + folded + after)
            proof = sha("".join(before + after for before, after in steps))
            out.append((row["doc_id"], leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def tampered(row):
    text, doc_id = row["text"], row["doc_id"]
    if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 3:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def found(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    out = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"text": text}).drop("siblings")
    return sorted((tuple(row) for row in out.collect()), key=repr)


# Blocks of 8 leaves, so that a few hundred rows go through several rounds with gaps in each.
@pytest.mark.parametrize("n", [0, 1, 8, 73, 520])
def test_every_size_of_tree(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [
        (None if k % 50 == 1 else k // 2 if k % 31 == 0 else k, f"Text {k}" if k % 7 else None, "a" if k % 3 else "bé", "s", k)
        for k in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == expected([row.asDict() for row in docs.collect()], tampered)


def test_many_trees_make_a_tree_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(k, "X" * k, None if k % 11 == 0 else f"l{k % 83}", None, None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == expected([row.asDict() for row in docs.collect()], tampered)


def test_odd_rows_of_a_manifest(odd_documents):
    docs = odd_documents
    for name in ("tree", "order", "leaf", "block", "lane", "peer", "levels", "place", "member.s", "_range"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(docs) == expected([row.asDict() for row in docs.collect()], tampered)


def test_a_change_in_any_field_shows(spark, documents):
    docs = documents(*[(k, f"text {k}") for k in range(20)])
    for field, changed in (("doc_id", F.col("doc_id") + 100), ("text", F.lit(None).cast("string")), ("n_chars", F.lit(0))):
        rows = merkle.manifest(docs, FIELDS, "lang", "doc_id", {field: F.when(F.col("doc_id") == 3, changed).otherwise(F.col(field))})
        assert [r.doc_id for r in rows.collect() if not r.verified] == [3]
    assert merkle.manifest(docs, FIELDS, "lang", "doc_id").filter("verified").count() == 20
