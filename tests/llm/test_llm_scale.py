import difflib
import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docengine.llm import near_duplicates, ocr_repair, vector_neighbours


def _texts(n: int) -> list[str]:
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.sample(vocabulary, 40) for _ in range(n)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for change in (2, 5, 9):
            other = words[:]
            for k in rng.sample(range(40), change):
                other[k] = rng.choice(vocabulary)
            rng.shuffle(other)
            out.append(" ".join(other))
    return out


def test_near_duplicates_against_brute_force(spark):
    texts = _texts(60)
    rows = [(f"c{i:03d}", t, "clash") for i, t in enumerate(texts)] + [("c000", texts[0], "clash"), ("copy", texts[0].upper(), "clash"), ("nul", None, "clash"), ("empty", "", "clash"), ("few", "a b c", "clash"), (None, texts[0], "clash")]
    table = spark.createDataFrame(rows, "chunk_id string, text string, words string")
    sets = {k: set(re.findall(r"[a-z0-9]+", t.lower())) for k, t, _ in rows if k and t}
    want = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if min(len(sets[p[0]]), len(sets[p[1]])) >= 20 and len(sets[p[0]] & sets[p[1]]) >= 0.7 * len(sets[p[0]] | sets[p[1]])}
    got = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(table).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    groups = near_duplicates.near_duplicate_groups(table).collect()
    by = {r.chunk_id: r.group for r in groups}
    assert len(by) == len(groups) and all(by[a] == by[b] for a, b in got)
    assert near_duplicates.near_duplicate_pairs(table.limit(0)).count() == 0


def test_large_class_of_copies_is_linked_to_its_first(spark):
    text = " ".join(f"w{i}" for i in range(30))
    table = spark.range(200).select(F.format_string("k%03d", "id").alias("chunk_id"), F.lit(text).alias("text"))
    pairs = near_duplicates.near_duplicate_pairs(table).collect()
    assert len(pairs) == 199 and {r.a for r in pairs} == {"k000"}


def test_large_class_of_different_texts_is_written_out(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SLOT", 16)
    words = [f"w{i}" for i in range(30)]
    order = lambda k: " ".join(words[k % 30 :] + words[: k % 30])
    rows = [(f"k{i:03d}", order(i) + "." * (i // 30)) for i in range(90)] + [(f"c{i:03d}", order(0) + "!") for i in range(70)] + [(f"n{i}", " ".join(words[:28]) + "," * i) for i in range(3)]
    got = near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    spoken = sorted(k for k, _ in rows if k[0] != "c" or k == "c000")
    want = {*itertools.combinations(spoken, 2)} | {("c000", f"c{i:03d}") for i in range(1, 70)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_latest_text_of_a_record_counts_and_hot_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BUCKET", 4)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"r{i:02d}", " ".join(words[:38] + [f"own{i}"]), 2.0) for i in range(30)]
    rows += [("r00", " ".join(f"z{i}" for i in range(30)), 1.0), ("r01", "few words now", 3.0), ("aa", " ".join(f"other{i}" for i in range(50)), 1.0), ("aa", " ".join(words[:38]), 5.0)]
    table = spark.createDataFrame(rows, "chunk_id string, text string, at double")
    got = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(table, latest_by="at").collect()}
    ids = sorted({"aa", *(f"r{i:02d}" for i in range(30))} - {"r01"})
    assert got == {*itertools.combinations(ids, 2)}
    groups = near_duplicates.near_duplicate_groups(table, latest_by="at").collect()
    assert {r.chunk_id for r in groups} == set(ids) and len({r.group for r in groups}) == 1 and all(r.head == r.chunk_id for r in groups)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 11)], "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(links, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}


def _vectors(spark, x):
    rows = [(f"v{i:04d}", [float(y) for y in v], "m") for i, v in enumerate(x)]
    bad = [("nan", [float("nan")] * 8, "m"), ("zero", [0.0] * 8, "m"), ("short", [1.0], "m"), ("null", None, "m"), ("v0000", [float(y) for y in x[0]], "other"), ("inf", [float("inf")] * 8, "m")]
    return spark.createDataFrame(rows + bad, "chunk_id string, embedding array<float>, part string")


def test_neighbours_exact_with_one_partition(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    got = {(r.chunk_id, r.neighbour) for r in vector_neighbours.nearest(_vectors(spark, x), 5, 8).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T - 3 * np.eye(60)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(60) for j in np.argsort(-sim[i])[:5]}
    assert got == want
    assert vector_neighbours.nearest(_vectors(spark, x).limit(0), 5, 8).count() == 0
    same = _vectors(spark, np.ones((7, 8)))
    assert vector_neighbours.nearest(same, 2, 8).filter("chunk_id = 'v0006'").orderBy("rank").select("neighbour").collect()[0][0] == "v0000"


def test_neighbours_recall_with_learned_partitions(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbours, "PART_ROWS", 100)
    monkeypatch.setattr(vector_neighbours, "BLOCK", 64)
    monkeypatch.setattr(vector_neighbours, "QUERY_BLOCK", 100)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 8)))
    got = {(r.chunk_id, r.neighbour) for r in vector_neighbours.nearest(_vectors(spark, x), 5, 8).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T - 3 * np.eye(1500)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(1500) for j in np.argsort(-sim[i])[:5]}
    assert len(got & want) / len(want) >= 0.95


def test_copies_of_one_vector_are_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbours, "PART_ROWS", 20)
    monkeypatch.setattr(vector_neighbours, "PROBES", 64)
    monkeypatch.setattr(vector_neighbours, "ROUTES", 64)
    x = np.random.default_rng(5).normal(size=(180, 8))
    x[40:100] = x[40]
    x[150:153] = x[150]
    got = {}
    for r in vector_neighbours.nearest(_vectors(spark, x), 5, 8).orderBy("chunk_id", "rank").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(12)
    sim = (unit @ unit.T).round(9) - 3 * np.eye(180)
    want = {f"v{i:04d}": [f"v{j:04d}" for j in np.argsort(-sim[i], kind="stable")[:5]] for i in range(180)}
    assert got == want


PAGE = "page_id long, document_id string, page_number int, raw_text string, cleaned_text string, used_ocr boolean, extracted_at timestamp, form string"


def test_scanned_pages(spark):
    body = "The hospital office returns the form within nine days of discharge and the broker signs the policy."
    clean = [(100 + i, "clean", i, body, body, False, None, "x") for i in range(6)]
    first = "ACME GUIDE\nThe hospita1 office returns the form with-\nin nine days. The pre-\nexisting list stays with the hos-\n- 7 -"
    second = "ACME GUIDE\npital office. The pre-existing list and the pre-existing form are here.\n4711\n- 8 -"
    scans = [(1, "d", 1, first, None, True, None, "x"), (2, "d", 2, second, None, True, None, "x"), (1, "d", 1, first, None, True, None, "x"), (3, "e", 1, None, None, True, None, "x"), (4, "e", 2, "", None, True, None, "x"), (5, None, None, "lone page", None, True, None, "x")]
    pages = spark.createDataFrame(clean + scans, PAGE)
    files = spark.createDataFrame([("d", "Acme", None)], "document_id string, insurer string, ingested_at timestamp")
    got = sorted((r.page_id, r.line_no, r.defect) for r in ocr_repair.line_defects(pages, files).collect())
    assert got == [(1, 1, "header"), (1, 2, "hyphen"), (1, 2, "ocr"), (1, 4, "hyphen"), (1, 5, "page_no"), (2, 1, "header"), (2, 4, "page_no")]
    fixed = {r.page_id: r.cleaned_text for r in ocr_repair.repaired_pages(pages, files).collect()}
    assert "hospital office returns the form within nine days" in fixed[1] and "pre-existing list stays with the hospital office." in fixed[1]
    assert ocr_repair.line_defects(pages.limit(0), files).count() == 0
    assert ocr_repair.repaired_pages(pages.limit(0), files).count() == 0
    assert ocr_repair.line_defects(pages.filter("used_ocr = false"), files).count() == 0


def test_repair_of_words_in_context(spark):
    """Whole words only, in their case, by the word before, over line and page ends; the text comes close to the clean one."""
    body = "All hospitals of the city return the form. The ward is open and the list is kept. We burn the old paper and the bum sleeps near the barn, as is known."
    clean = [(100 + i, f"clean{i}", i, body, body, False, None, "x") for i in range(8)]
    said = "The clause ls valid for all hospitals of the city.\nALL HOSPlTALS return the form. We bum the old paper but the bum sleeps.\nThe ward ls open and the l1st is kept in the hos-\np1tals of the city."
    want = "The clause is valid for all hospitals of the city. ALL HOSPITALS return the form. We burn the old paper but the bum sleeps. The ward is open and the list is kept in the hospitals of the city."
    scans = [(1, None, 1, said, None, True, None, "x"), (2, None, 1, "lone page with a l1st", None, True, None, "x")]
    pages = spark.createDataFrame(clean + scans, PAGE)
    files = spark.createDataFrame([("d", "Acme", None)], "document_id string, insurer string, ingested_at timestamp")
    fixed = {r.page_id: r.cleaned_text for r in ocr_repair.repaired_pages(pages, files).collect()}
    assert "for all hospitals of" in fixed[1] and fixed[2] == "lone page with a list"
    assert difflib.SequenceMatcher(None, fixed[1], want, autojunk=False).ratio() > 0.98
    assert ocr_repair.line_defects(pages, files).filter("page_id = 1 and line_no = 4 and defect = 'ocr'").count() == 1


def test_one_form_with_two_meanings_on_a_line(spark):
    rows = [(1, "We bum the paper and the bum sleeps, BUM it.", [("in", "we", "bum", "burn"), ("in", "the", "bum", "bun")])]
    line = spark.createDataFrame(rows, "id long, line string, fixes array<struct<place:string,prev:string,form:string,meant:string>>")
    assert line.select(ocr_repair._mended(F.col("line"), F.col("fixes"))).first()[0] == "We burn the paper and the bun sleeps, BUM it."
    numerals = {"i": 1, "iv": 4, "xc": 90, "cdxliv": 444, "mcmxcix": 1999, "mmmmcm": 4900}
    got = spark.createDataFrame([(k,) for k in numerals], "r string").select("r", ocr_repair._roman_value(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in got} == numerals


def test_words_of_scans_are_split_at_once_and_counted_without_lambdas(spark):
    odd = ["", " ", "-", "a- -b", "a -- - b", "(-b) c-", "NL-6613 ab-CD-12 xNL-1 ÄB- 7", "x-\n- item", "ein­ge-\n  teilt ﬁne", "1,234 -- €5", "a-b--c- - -d", "W0rd, wörd."]

    def plainly(text):
        low = re.sub(r"\b[A-ZÄÖÜ]{1,4}-\s*\d+\b", " ", text).lower()
        kept = re.sub(r"[^a-zäöüß0-9@!+$£€¢ﬁﬂ\-]+", " ", low)
        return re.split(" +", re.sub(r" -+|-+ ", " ", f" {kept} "))

    rows = spark.createDataFrame([(x,) for x in odd], "text string")
    assert [r.w for r in rows.select(ocr_repair._tokens(F.col("text")).alias("w")).collect()] == [plainly(x) for x in odd]
    said = [x for x in odd if "\n" not in x]
    texts = spark.createDataFrame([(True, x) for x in said], "scanned boolean, text string")
    pairs = ocr_repair.word_forms(texts, spark.createDataFrame([], "head string, tail string"))
    assert {(r.prev, r.form): r.n for r in pairs.collect()} == Counter(p for x in said for p in zip(plainly(x), plainly(x)[1:]) if len(p[1]) > 1)
    assert "lambda" not in pairs._jdf.queryExecution().executedPlan().toString()
