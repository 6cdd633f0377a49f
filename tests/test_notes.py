import random
import re

import pytest
from pyspark.sql import functions as F

from quizlake.operators import notes
from quizlake.plans.journeys import prompts_from_parts
from quizlake.sources.note_files import notes_from_files, read_note_files, with_empty_files
from tests.plans import initial_plan

PARTS = "note_id bigint, part_no bigint, text string"


def joined(rows):
    result = {}
    for note in {r[0] for r in rows}:
        parts = sorted((r for r in rows if r[0] == note), key=lambda r: r[1])
        result[note] = "\n".join(p[2] or "" for p in parts).strip()
    return result


def test_assembly_equals_join_and_strip(spark):
    rows = [
        (1, 2, "c"), (1, 0, " \n a "), (1, 1, None), (1, 10, "d\t"),
        (2, 0, None), (2, 1, " "),
        (3, 5, "only"),
    ]
    got = notes.assemble_notes(spark.createDataFrame(rows, PARTS)).collect()
    assert {r["note_id"]: r["text"] for r in got} == joined(rows)


def test_a_note_of_many_parts_is_one_row(spark):
    random.seed(2)
    rows = [(note, part, random.choice([None, " ", "word " * 5, "\té\n"])) for note in (1, 2) for part in range(4000)]
    random.shuffle(rows)
    got = notes.assemble_notes(spark.createDataFrame(rows, PARTS).repartition(5)).collect()
    assert {r["note_id"]: r["text"] for r in got} == joined(rows) and len(got) == 2


def test_routes(spark):
    names = {
        "a.PDF": "pdf", "b.docx": "docx", "c.RTF": "rtf", "d.odt": "odt", "e.pptx": "pptx",
        "f.txt": "text", "g": "text", "pdf": "text", "h.pdf.md": "text",
    }
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = frame.select("n", notes.note_route(F.col("n")).alias("r")).collect()
    assert {r["n"]: r["r"] for r in got} == names


@pytest.mark.parametrize(
    ("name", "text", "error", "status"),
    [
        ("a.pdf", "x" * 50, None, "ok"),
        ("a.pdf", " " + "x" * 49 + " ", None, "scanned_or_empty"),
        ("a.PDF", None, None, "scanned_or_empty"),
        ("a.txt", "x" * 49, None, "ok"),
        ("a.txt", "  ", None, "empty"),
        ("a.docx", "text", "not a zip file", "extraction_error"),
        ("a.pdf", None, "EOF marker not found", "extraction_error"),
    ],
)
def test_gate(spark, name, text, error, status):
    frame = spark.createDataFrame(
        [(1, name, text, error)], "note_id bigint, file_name string, text string, extract_error string"
    )
    row = notes.gate_notes(frame).collect()[0]
    assert row["status"] == status
    assert row["text"] == ((text or "").strip() if status == "ok" else "")
    if status == "extraction_error":
        assert row["message"] == "Error extracting text: " + error
    accepted = notes.accepted_notes(notes.gate_notes(frame)).count()
    assert accepted + notes.quarantined_notes(notes.gate_notes(frame)).count() == 1


def test_files_to_notes(spark, tmp_path):
    contents = {
        "good.txt": " héllo ".encode(),
        "bad.TXT": b"a\xffb\xc3",
        "empty.md": b"",
        "sub/n.rtf": b"{\\rtf1 x\xff}",
        "doc.pdf": b"%PDF\xff",
    }
    for name, data in contents.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(data)
    uploads = spark.createDataFrame([(f"file:{tmp_path}/{name}",) for name in contents], "path string")
    files = with_empty_files(read_note_files(spark, str(tmp_path)), uploads)
    assert files.count() == len(contents)
    got = {r["file_name"]: r for r in notes_from_files(files).collect()}
    assert got["good.txt"]["text"] == "héllo"
    assert got["bad.TXT"]["text"] == "ab"
    assert got["empty.md"]["text"] == ""
    assert got["n.rtf"]["route"] == "rtf" and got["n.rtf"]["markup"] == "{\\rtf1 x}"
    assert got["doc.pdf"]["text"] is None and bytes(got["doc.pdf"]["content"]) == b"%PDF\xff"


def test_prompt(spark):
    text = "{difficulty} 100% {num_questions} " + "é" * 5000
    requests = spark.createDataFrame(
        [(1, text, 3, "Hard"), (2, "n", None, None), (3, "n", 51, "Easy"), (4, "n", 0, "Easy"), (5, "n", 1, "easy")],
        "note_id bigint, text string, num_questions int, difficulty string",
    )
    rows = {r["note_id"]: r for r in notes.build_prompts(requests).collect()}
    assert rows[1]["prompt"].startswith("You are an expert quiz generator. Create 3 multiple-choice")
    assert "\nDifficulty level: Hard\n" in rows[1]["prompt"]
    assert rows[1]["prompt"].endswith("NOTES:\n" + text[:4000] + "\n")
    assert (rows[2]["num_questions"], rows[2]["difficulty"]) == (10, "Medium")
    assert [rows[i]["settings_ok"] for i in range(1, 6)] == [True, True, False, False, False]
    assert all((rows[i]["prompt"] is None) == (not rows[i]["settings_ok"]) for i in rows)


def test_parts_to_prompts(spark):
    parts = spark.createDataFrame([(1, 1, "two"), (1, 0, " one"), (2, 0, None), (3, 0, "x" * 49)], PARTS)
    files = spark.createDataFrame([(1, "a.docx"), (2, "b.pptx"), (3, "c.pdf")], "note_id bigint, file_name string")
    settings = spark.createDataFrame(
        [(i, 5, "Easy") for i in (1, 2, 3)], "note_id bigint, num_questions int, difficulty string"
    )
    got = prompts_from_parts(parts, files, settings).collect()
    assert [r["note_id"] for r in got] == [1]
    assert got[0]["prompt"].endswith("NOTES:\none\ntwo\n")


def test_heads_equal_whole_notes_cut_short(spark):
    """Blank parts and blanks at both ends, empty notes, and a note of a third of all parts."""
    pick = random.Random(9)
    texts = ["", " ", "\n\t", None, "a", " b ", "word", "  two words\u00a0", "x" * 7]
    rows = [(n, p, pick.choice(texts)) for n in range(120) for p in range(pick.randrange(0, 14))]
    rows += [(500, p, "y" * (p % 5)) for p in range(400)] + [(501, 0, "z" * 1000), (501, 1, None), (502, 3, None)]
    pick.shuffle(rows)
    parts = spark.createDataFrame(rows, "note_id bigint, part_no int, text string").repartition(5)
    whole = {r.note_id: r.text for r in notes.assemble_notes(parts).collect()}
    for limit in (1, 6, 25):
        heads = notes.note_heads(parts, limit)
        found = {r.note_id: (r.text, r.n_chars) for r in heads.collect()}
        assert found == {n: (text[:limit], len(text)) for n, text in whole.items()}
        assert re.search(r"hashpartitioning\(note_id#\d+L, piece", initial_plan(heads))
