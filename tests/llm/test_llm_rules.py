import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.llm import answer_pairs, boilerplate, leakage, mixture, splitting, template_residue

PAGE = "page_id long, document_id string, cleaned_text string, extracted_at timestamp, source string, line string"
FILE = "document_id string, insurer string, ingested_at timestamp, line string"


def pages(spark, *rows):
    return spark.createDataFrame([(p, d, t, None, "clash", "clash") for p, d, t in rows], PAGE)


def files(spark, *rows):
    return spark.createDataFrame([(d, i, None, "clash") for d, i in rows], FILE)


# --- splitting


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence ends. ", "\n\n", "long" * 30 + " ", "é", "x" * 250]), max_size=120))
def test_pieces_cover_the_text(parts):
    text = "".join(parts)
    pieces = splitting.cut_text(text, 200, 20)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 200 for a, b in pieces)
    assert all(b[0] <= a[1] and b[0] > a[0] and a[1] - b[0] <= 20 for a, b in zip(pieces, pieces[1:]))


def test_boundaries(spark):
    long = "w " * 60
    rows = pages(spark, (1, "d", "a" * 90 + "\n \n" + "b" * 90), (2, "d", ("c" * 50 + ". ") * 4), (3, "d", long), (4, "d", "z" * 150), (5, "d", None), (6, "d", ""), (7, "d", "short"), (1, "d", "a" * 90 + "\n \n" + "b" * 90))
    got = splitting.split_oversized(rows, 100, 10).select("page_id", "boundary").distinct().collect()
    assert {(r.page_id, r.boundary) for r in got} == {(1, "paragraph"), (2, "sentence"), (3, "word"), (4, "none")}
    assert splitting.split_oversized(rows.limit(0), 100, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(rows, 100, 50)


def test_ends_in_the_first_half_of_the_window():
    words = "word " * 60
    for end in ("\n\n", ". "):
        text = "a" * 49 + end + words
        assert splitting.cut_text(text, 200, 20)[0] == (0, 49 + len(end))
    text = "a" * 39 + "\n\n" + "b" * 100 + ". " + words  # the paragraph end goes before the later sentence end
    assert splitting.cut_text(text, 200, 20)[0] == (0, 41)
    text = "a" * 39 + "\n\n" + "b" * 100 + "\n\n" + words  # of two paragraph ends the one in the upper half goes first
    assert splitting.cut_text(text, 200, 20)[0] == (0, 143)


def _boundary(text, limit):
    paragraphs = re.split(r"\n\s*\n", text)
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)]
    for name, units in (("paragraph", paragraphs), ("sentence", sentences), ("word", text.split())):
        if max((len(u.strip()) for u in units), default=0) <= limit:
            return name
    return "none"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["w ", "word ", "End. ", "stop!\n", "\n\n", "  ", "\n \n", "long" * 5, "x" * 31, "x" * 40, " ", "\n", "?"]), max_size=60))
def test_forced_cuts_tell_the_boundary(parts):
    text = "".join(parts)
    assert splitting.Segmentation(text).forced(40) == _boundary(text, 40)


def test_deepest_valley_is_taken_and_long_texts_are_linear():
    one, two = "The hospital admits insured patients daily. ", "Premium invoices arrive every quarter promptly. "
    text = one * 12 + two * 30
    assert splitting.cut_text(text, 1000, 50)[0] == (0, len(one) * 12)
    began = time.process_time()
    pieces = splitting.cut_text((one + two) * 20_000, 2000, 200)
    assert len(pieces) > 800 and time.process_time() - began < 60


# --- repeated lines


def test_repeated_lines(spark):
    rows = pages(spark, *[(i, f"d{i}", f"Page {i}  of 9\nown text {'abc'[i]}\n\n") for i in range(3)], (9, "d9", None), (8, "d8", "Page 1 of 9"), (0, "d0", "Page 0  of 9\nown text a\n\n"))
    source = files(spark, ("d0", "A"), ("d1", "A"), ("d2", "A"), ("d8", None), ("d9", "A"))
    got = sorted((r.page_id, r.line_no) for r in boilerplate.repeated_lines(rows, source).collect())
    assert got == [(0, 1), (1, 1), (2, 1)]
    kept = {r.page_id: r.cleaned_text for r in boilerplate.strip_repeated(rows, source).collect()}
    assert kept[1] == "own text b\n\n" and kept[8] == "Page 1 of 9"
    assert boilerplate.repeated_lines(rows.limit(0), source).count() == 0
    near = boilerplate.repeated_lines(pages(spark, *[(i, f"d{i}", f"Printed for {n} Smith today") for i, n in enumerate(["Ann", "Bob", "Cyd"])]), source, near=True)
    assert near.count() == 3


def test_alike_clusters_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "BUCKET", 8)
    rng = random.Random(5)
    vocabulary = [f"w{i}x" for i in range(300)]
    lines = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(40)]
        lines.append(base)
        for change in (1, 1, 2):
            other = base[:]
            for k in rng.sample(range(1, 40), change):
                other[k] = rng.choice(vocabulary)
            lines.append(other)
    lines += [[*lines[0][:39], f"end{i}"] for i in range(30)] + [["short", "line"], ["short", "lines"]]
    masked = [" ".join(x) for x in lines]
    shingles = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    root = list(range(len(lines)))
    for _ in lines:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    forms = spark.createDataFrame([("s", i, m) for i, m in enumerate(masked)] + [("t", 1000 + i, masked[i]) for i in range(3)], "source string, form_id long, masked string")
    got = {r.form_id: r.cluster for r in boilerplate.alike_clusters(forms).collect()}
    found = sum(got[i] == got[j] for i, j in near)
    assert len(got) == len(lines) + 3 and found >= 0.98 * len(near) and len(near) > 400
    assert all(root[i] == root[j] for i in range(len(lines)) for j in range(i) if got[i] == got[j])
    assert not {got[1000 + i] for i in range(3)} & {got[i] for i in range(len(lines))}


def test_clusters_come_from_the_buckets(spark, monkeypatch):
    rows = pages(spark, *[(i, f"d{i}", "The same line stands here.") for i in range(3)])
    source = files(spark, *[(f"d{i}", "A") for i in range(3)])
    assert boilerplate.repeated_lines(rows, source).count() == 3
    monkeypatch.setattr(boilerplate, "BANDS", 0)
    assert boilerplate.repeated_lines(rows, source).count() == 0


# --- leakage


def test_leaks_match_brute_force(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "too short"), (1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(words[3:15]), " ".join(words[3:14]), "X, " + "; ".join(words[20:32]).upper() + "!", None, "", "y " * 5000 + " ".join(words[:12]), " ".join(words[:6] + ["zz"] + words[6:12])]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5)], "doc_id long, text string, item_id int")
    split = lambda t: re.findall(r"[^\W_]+", t.casefold())
    grams = {tuple(words[k : k + 12]) for k in range(29)}
    want = {i for i, t in enumerate(texts) if t and any(tuple(split(t)[k : k + 12]) in grams for k in range(len(split(t)) - 11))}
    got = leakage.leaks(docs, items).collect()
    assert {r.doc_id for r in got} == want == {0, 2, 5} and len(got) == 3
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_leaks_with_edits(spark, monkeypatch):
    words = [f"passage{i}" for i in range(14)]
    whole = " ".join(words)
    near = [whole.replace("passage5", "pasage5"), whole.replace("passage5", "pasage5").replace("passage9", "paassage9"), whole.replace("passage5", "psge5").replace("passage9", "paasssage9"), whole.replace(" passage6", ""), "other " * 20 + whole.replace("e7", "f7") + " end" * 9]
    texts = [*near, " ".join(words[:12]), " ".join(words[:11]), None, "", near[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, whole), (1, "something else " * 9), (2, None)], "item_id long, text string")
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t)) + " "
    runs = [" " + " ".join(words[k : k + 12]) + " " for k in range(3)]
    want = {i for i, t in enumerate(texts) if t and any(_edit_distance(r, norm(t)[a : a + n]) <= 2 for r in runs for a in range(len(norm(t))) for n in range(len(r) - 2, len(r) + 3) if norm(t)[a : a + 1] == " ")}
    assert {0, 1, 4, 5, 9} <= want and not want & {2, 6}
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, edits=2).collect()}
    assert got == {(i, 1) for i in want}
    monkeypatch.setattr(leakage, "INDEX_CHARS", 10)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, edits=2).collect()} == got
    assert {r.doc_id for r in leakage.leaks(docs, items).collect()} == {5} | {i for i, t in enumerate(texts) if t and any(r in norm(t) for r in runs)}
    with pytest.raises(ValueError):
        leakage.leaks(docs, items, edits=leakage.BAND)
    with pytest.raises(ValueError):
        leakage.leaks(docs, items, edits=31)


# --- mixture


def test_source_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "en", None), (2, "a, b", "y", None, "t"), (3, None, "x", "en", "t"), (4, "no target here", "z", "en", "t")], "doc_id long, text string, source string, lang string, document_type string")
    targets = spark.createDataFrame([("x", 0.5, 3), ("y", 0.5, 1), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: (r.tokens, r.copies, r.status) for r in mixture.source_plan(docs, targets).collect()}
    assert got == {"x": (4, 1, "met"), "y": (3, 1, "short"), "gone": (0, 0, "short")}
    drawn = mixture.mix(docs, targets).collect()
    assert all(r.repeats <= 3 for r in drawn) and "z" not in {r.source for r in drawn}
    assert mixture.source_plan(docs.limit(0), targets).filter("copies <> 0 or status <> 'short'").count() == 0


def test_rake_meets_marginals(spark):
    rows = [(i, "a " * (1 + i % 5), "xy"[i % 2], ["en", "de"][i % 3 == 0], "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, document_type string")
    targets = spark.createDataFrame([("x", 0.7, 9), ("y", 0.3, 9)], "source string, target_share double, max_repeats int")
    fit = mixture.rake(docs, targets).groupBy("source").agg(F.sum("weight").alias("w")).collect()
    total = sum(r.w for r in fit)
    assert {r.source: round(r.w / total, 6) for r in fit} == {"x": 0.7, "y": 0.3}
    wanted = spark.createDataFrame([("en", 1.0), ("de", 3.0), ("xx", 5.0)], "lang string, share double")
    fit = mixture.rake(docs, targets, lang_shares=wanted).collect()
    total = sum(r.weight for r in fit)
    assert abs(sum(r.weight for r in fit if r.lang == "de") / total - 0.75) < 1e-4 and abs(sum(r.weight for r in fit if r.source == "x") / total - 0.7) < 1e-6


def test_short_source_draws_all_its_repeats(spark):
    rows = [(i, "a " * (1 + i % 5), "short", ["en", "de"][i % 10 == 0], "tu"[i % 4 == 0]) for i in range(60)]
    rows += [(i, "a " * 40, "rich", ["de", "en"][i % 10 == 0], "ut"[i % 4 == 0]) for i in range(60, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, document_type string")
    targets = spark.createDataFrame([("short", 0.5, 3), ("rich", 0.5, 2)], "source string, target_share double, max_repeats int")
    drawn = {r.doc_id: r.repeats for r in mixture.mix(docs, targets).filter("source = 'short'").collect()}
    assert drawn == {i: 3 for i in range(60)}
    fit = mixture.rake(docs, targets).collect()
    assert all(r.rate <= {"short": 3, "rich": 2}[r.source] for r in fit)
    assert round(sum(r.weight for r in fit if r.source == "rich"), 6) == 0.5 * sum(len(t.split()) for _, t, *_ in rows)


# --- template residue


def test_residue(spark):
    real = "The quick manager returns the form to the desk after nine days."
    cases = {
        "Dear {{ first_name }}, " + real: "placeholder", real + " Pay ${amountDue} now.": "placeholder", real + " [INSERT NAME]": "placeholder", real + " Of the group {a, b, c} only b applies.": None,
        real + " See [annex 3] and `{{ name }}`.": None, 'A sample record reads {"plan": "X", "limit": 3} and was sent.': None, "Lorem ipsum dolor sit amet consectetur.": "filler", "bla " * 20: "filler", "wsd kjh qwe rty dfg hjk lkj poi uyt": "filler",
        "404 Not Found\nThe requested document could not be located on this server.": "error_page", "Home | Plans\nError 503: service temporarily unavailable. Retry later.": "error_page", "The error rate of the scanner fell to 40 percent.": None,
        "Please enable JavaScript to view this page.": "script_notice", "JavaScript is disabled. You need it to read this leaflet.": "script_notice", "Since spring the member area works without any scripts, as A. Bo confirmed.": None, real: None, "": None, "  \n": None, None: None,
    }
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(cases)] + [(0, next(iter(cases)), "clash")], "doc_id long, text string, defect string")
    got = {r.doc_id: r.defect for r in template_residue.residue(docs).collect()}
    assert got == {i: d for i, d in enumerate(cases.values()) if d}
    assert template_residue.residue(docs.limit(0)).count() == 0
    assert template_residue.without_residue(docs).select("doc_id").distinct().count() == len(cases) - len(got)


def test_cues_are_reached_in_the_query(spark):
    errors = ["401 Unauthorized", "410 Gone", "Acceso denegado", "Accès interdit", "Zugriff nicht gestattet", "Página no encontrada", "This page has been removed", "The page is no longer available", "Segmentation fault", "The document could not be displayed", "Home. 410 Gone", "Home | Plans\n410", "Die Sitzung ist abgelaufen.", "The file was moved."]
    told = "L'espace réservé {{ prénom }} est remplacé par le nom."
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*errors, told, "The desk keeps the form. todo: add the name of the member."])], "doc_id long, text string")
    got = {r.doc_id: r.defect for r in template_residue.residue(docs).collect()}
    assert got == {i: "error_page" for i in range(len(errors))} | {len(errors) + 1: "placeholder"}


def _samples(pattern):
    """A string for each alternative of the pattern, in which optional parts are left out."""
    from re import _parser

    def walk(tree):
        texts = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "BRANCH":
                more = [t for branch in arg[1] for t in walk(branch)]
            elif name == "SUBPATTERN":
                more = walk(arg[3])
            elif name == "MAX_REPEAT":
                more = walk(arg[2]) if arg[0] else [""]
            elif name == "IN":
                more = [chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0]) if str(arg[0][0]) == "RANGE" else "4"]
            elif name == "ANY":
                more = ["x"]
            else:
                more = [""]
            texts = [t + m for t in texts for m in more][:400]
        return texts

    return walk(_parser.parse(pattern))


def test_gates_hold_a_word_of_every_cue():
    for cues in (template_residue.ERROR_CUES, template_residue.SCRIPT_CUES):
        for words, pattern in cues:
            assert not words or all(any(w in t for w in words) for t in _samples(pattern)), pattern
    assert all(any(w in t for w in template_residue.FILLER_WORDS) for t in _samples(template_residue.FILLER_PHRASES.replace(r"\p{L}", "x")))


def test_residue_is_judged_by_density_and_passage(spark):
    cases = {
        "The auditor reports that the page was not found among the papers of the ward.": None,
        "The broker wrote that access is denied to visitors of the ward after nine in the evening.": None,
        "Dear {{ name }}, the syntax of your claim {{ claim_no }} is not what the desk expects.": "placeholder",
        "In a letter the tag {{ name }} is replaced by the name of the member.": None,
        "In a letter the tag {{ name }} is replaced by the name of the member. Dear {{ name }}, we thank you.": "placeholder",
        "Error 503: service unavailable.\n" + " ".join(f"The desk pays bill {n} within {n} days of the {w} discharge." for n, w in enumerate("first second third fourth".split())): None,
        "Nothing to see yet. Nothing to see yet. Nothing to see yet. Nothing to see yet.": "filler",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.defect for r in template_residue.residue(docs).collect()} == {i: d for i, d in enumerate(cases.values()) if d}


# --- broken pairs


def test_broken_pairs(spark):
    good = "The desk pays the bill within nine days of discharge. The broker signs the form for the member."
    pairs = {
        ("Who pays the bill for the member?", None): "empty", ("Who pays the bill for the member? ", "<p></p>"): "empty", ("Who pays the bill?", "​ n/a"): "empty", ("Who pays the bill now?", "No."): None,
        ("Who pays the bill for the ward?", "Who pays the bill for the ward?"): "copied", ("Who pays the bill for the wards?", "You asked: who pays the bill for the wards"): "copied", ("Who pays the bill for a ward?", "You asked: Who pays the bill for a ward? " + good): None,
        ("Is it covered?", "I'm sorry, but I can’t help with that request."): "refusal", ("Is it covered now?", "Sorry to hear about the delay. " + good): None,
        ("Who pays the bill of the ward?", "Die Apotheke prüft die Zuzahlung und das Mitglied legt eine Kopie in der Akte ab."): "other_language", ("Wer bezahlt die Rechnung der Station?", "Die Apotheke prüft die Zuzahlung und das Mitglied legt eine Kopie in der Akte ab."): None,
        ("What is due?", good + " The broker signs the"): "truncated", ("What is due now?", "The broker signs..."): "truncated", ("What is due here?", good + " [C_12ab34cd]"): None, ("How long?", "44 days"): None,
    }
    asked = spark.createDataFrame([(i, q, None, "x") for i, (q, _) in enumerate(pairs)], "request_id long, query string, logged_at timestamp, defect string")
    said = [(i, a, f"2024-01-02 00:00:{i:02d}") for i, (_, a) in enumerate(pairs)] + [(3, "", "2023-01-01 00:00:00"), (99, "", "2024-01-01 00:00:00")]
    answers = spark.createDataFrame(said, "request_id long, synthesized_answer string, at string").withColumn("responded_at", F.to_timestamp("at"))
    got = {r.request_id: r.defect for r in answer_pairs.defects(asked.union(asked), answers.union(answers)).collect()}
    assert got == {i: d for i, d in enumerate(pairs.values()) if d}
    assert answer_pairs.defects(asked.limit(0), answers).count() == 0


def test_refusals_of_any_length_and_wording(spark):
    good = "The desk pays the bill within nine days of discharge. The broker signs the form for the member."
    pairs = {
        "Thank you for your question about the ward.\nI'm sorry, but I can't help with that request.\nPlease contact a person at the desk for more.": "refusal",
        "We have looked at this with care. " * 12 + "\nOur assistant is not permitted to say anything on the matter, and we regret that. " + "Please ask a human colleague instead. " * 9: None,
        "Please understand that this has been looked at. " * 12 + "\nOur assistant is not permitted to respond to questions of this kind.": "refusal",
        "That is a matter on which I would much rather not offer an opinion.": "refusal",
        "My rules keep me from that, so I will not be answering the question.": "refusal",
        "Leider darf ich dazu keine Auskunft geben. Bitte wenden Sie sich an eine Kollegin.": "refusal",
        "No. " + good + " I can help with the form if needed.": None,
        "I can not say which ward it was. " + good: None,
        "The no-claim bonus is lost if our member does not answer the letter in nine days. " + good: None,
    } | {t: "refusal" for t in answer_pairs.REFUSALS}
    asked = spark.createDataFrame([(i, "Who pays the bill of the ward in spring?", None) for i in range(len(pairs))], "request_id long, query string, logged_at timestamp")
    answers = spark.createDataFrame([(i, a) for i, a in enumerate(pairs)], "request_id long, synthesized_answer string").withColumn("responded_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.request_id: r.defect for r in answer_pairs.defects(asked, answers).filter("defect in ('refusal', 'copied', 'other_language')").collect()}
    wrong = {a: got.get(i) for i, (a, d) in enumerate(pairs.items()) if got.get(i) != d}
    assert not wrong
    assert all(not answer_pairs._DENIAL.isdisjoint(t) for t in answer_pairs._TEMPLATES)


def test_copies_of_any_length():
    asked = answer_pairs._tokens("Who pays the bill of the ward in spring?")
    assert answer_pairs._copied(asked, asked * 300) and not answer_pairs._copied(asked, asked + "the desk pays it within nine days and the member keeps a copy".split())
    a, b = "a b c d e f g".split(), "x b d c f g a".split()
    assert answer_pairs._lcs(a, b) == 4 and answer_pairs._lcs([], b) == 0


def test_counts_of_tokens(spark):
    texts = ["a b", "", None, "x-y z!", "é 12", "a_b"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixture.token_count(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\W_]+|[^\w\s]|_", t or "")) for t in texts]
    assert Counter(got)[0] == 2
