"""Licence scans, fingerprints and decontamination against plain versions on small tables."""

import hashlib
import re

import pytest

from folioscope.llm import decontamination, license_scans, merkle
from folioscope.llm.templates import LICENSES

PYTHON_NODES = re.compile("Python|Pandas|Arrow")


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def no_python(df):
    assert not PYTHON_NODES.search(df._jdf.queryExecution().executedPlan().toString())


LICENSED = [
    "Released under the MIT License.", "Prose here.\nReleased under the MIT License!\nMore prose here", "released under the mit licence", None, "", "\n\n", "one",
    LICENSES[2][1], LICENSES[2][1].replace("furnished", "given"), "word " * 20_000, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "MIT",
    "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
]


def test_licenses(docs_of, shipped):
    templates = shipped.createDataFrame([*LICENSES, ("none", None), ("short", "x"), ("MIT", LICENSES[0][1])], "license_id string, text string")
    docs = docs_of([*LICENSED, LICENSED[0]]).selectExpr("*", "1 as line", "2 as row")
    found = license_scans.find_licenses(docs, templates)
    no_python(found)
    want = []
    for i, text in enumerate([*LICENSED, LICENSED[0]]):
        lines = (text or "").split("\n")
        for n, unit in [*enumerate(lines, 1), *([(0, text)] if len(lines) > 1 else [])]:
            for name, template in dict.fromkeys((n_, " ".join(words(t))) for n_, t in LICENSES):
                a, b = grams(unit, 2), grams(template, 2)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                    want.append((i, n, name, len(a & b), 2 * len(a & b) / (len(a) + len(b))))
    assert sorted((r.doc_id, r.line, r.license_id, r.n_shared, r.dice) for r in found.collect()) == sorted(want)
    assert license_scans.find_licenses(docs.filter("false"), templates).count() == 0
    assert license_scans.find_licenses(docs, templates.filter("false")).count() == 0


ITEM = "what is the name of the river that runs through the old town and under the stone bridge"
ITEMS = [(1, ITEM), (1, ITEM), (2, "Five words are here, now"), (3, "too few words"), (4, None), (5, ""), (None, "an item without any id at all"), (6, ITEM.upper() + "?")]
HOLDERS = [
    "x " * 400 + ITEM + " y" * 400, ITEM.replace(" ", "\n"), ITEM.replace("name", "title"), ITEM.replace("stone", "iron"), "five WORDS are here now", None, "", "too few words",
    "say: an item without any id at all!", "the old town and under the stone bridge", (ITEM + " ") * 2000, "what is the name of the river that runs",
]


def test_contained_items(docs_of, shipped):
    items = shipped.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = docs_of([*HOLDERS, HOLDERS[1]]).selectExpr("*", "1 as item_id", "2 as key")
    found = decontamination.contained(docs, items)
    no_python(found)
    want = []
    for i, text in enumerate([*HOLDERS, HOLDERS[1]]):
        for item_id, item in dict.fromkeys((k, " ".join(words(t))) for k, t in ITEMS):
            of, inside = grams(item, 5), grams(text, 5)
            if of and 10 * len(of & inside) >= 8 * len(of):
                want.append((i, item_id or -1, len(of), len(of & inside)))
    got = [(r.doc_id, r.item_id or -1, r.n_shingles, r.n_shared) for r in found.collect()]
    assert sorted(got) == sorted(want)
    clean = decontamination.without_contaminated(docs, items)
    assert clean.columns == docs.columns
    gone = {w[0] for w in want}
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(HOLDERS) + 1) if i not in gone]
    assert decontamination.contained(docs, items.filter("false")).count() == 0
    assert decontamination.contained(docs.filter("false"), items).count() == 0


def test_shuffled_search_gives_the_same(docs_of, shipped, monkeypatch):
    monkeypatch.setattr("folioscope.llm.shingles.BROADCAST_ROWS", 0)
    items = shipped.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {r.doc_id for r in decontamination.contained(docs_of(HOLDERS), items).collect()} >= {0, 1, 4, 8, 10}


def test_a_class_keeps_enough_for_each_member(shipped):
    from pyspark.sql import functions as F

    sizes = shipped.range(1, 3000).select("id", decontamination.sketch_size(F.col("id"), 0.8).alias("k"))
    assert sizes.filter("k < id - ceil(round(id * 0.8, 6)) + 1").count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(text):
    sections = [[sha("paragraph " + p) for p in s.split("\n")] for s in text.split("\n\n")]
    return sha("document " + "".join(sha("section " + "".join(s)) for s in sections))


def twigs(text):
    return {m for m in re.findall(r"(?:[^ \n]+ *){1,4}", text)}


def likeness(a, b):
    x, y = twigs(a), twigs(b)
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


FINGERED = [
    (5, "one two three four five six seven eight nine ten eleven twelve"), (9, "first line\nsecond line\n\nnew section\n"), (7, None), (3, ""), (1, "é😀x y z" * 3000),
    (None, "null id"), (2, "\n\n\n"), (8, "  "), (4, "short"), (6, "a\nb\n\nc d e f g h"),
]


def test_fingerprints(docs_of):
    rows = docs_of(FINGERED).selectExpr("*", "1 as part", "'x' as before")
    result = merkle.compare_with_next(rows)
    no_python(result)
    order = sorted(FINGERED, key=lambda p: (p[0] is None, -(p[0] or 0)))
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want[i] = (len(text), sha(edited), plain_root(text), plain_root(edited), likeness(text, edited), likeness(text, after))
    got = {r.doc_id: tuple(r)[1:] for r in result.collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:4] == row[:4] and got[i][4:] == pytest.approx(row[4:])


def test_ties_repeats_and_single_rows(docs_of, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 2)
    tied = docs_of([(1, "a b c d e f")] * 5 + [(1, "other text here"), (2, "a b c d e f"), (None, None), (None, None)])
    rows = merkle.compare_with_next(tied).collect()
    assert len(rows) == 9
    assert len({r.fingerprint for r in rows if r.n_chars == 11}) == 1
    single = merkle.compare_with_next(docs_of(["alone in the world"])).first()
    assert single.near_next == 1.0 and single.edited_sha256 == sha("alone in the world"[:12] + "alone "[:6])
    assert merkle.compare_with_next(docs_of(["x"]).filter("false")).count() == 0


def test_edits_are_located(shipped):
    a, b = "p0\np1\n\nq0\nq1", "p0\np1\n\nq0\nchanged\nnew\n\nr0"
    row = shipped.createDataFrame([(a, b)], "a string, b string").select(merkle.edits(*map(__import__("pyspark").sql.functions.col, "ab")).alias("e")).first()
    assert [(e.section, e.paragraph) for e in row.e] == [(1, 1), (1, 2), (2, 0)]
