"""Noise in text from scanned pages (problem 1): running lines, page numbers, divided words and misread characters.

Words are grouped by a skeleton in which glyphs that are mistaken for each other are alike; in each group the frequent forms, those
seen in the same context first, stand for the rest. Running lines are found by their text without digits, and the
pages are put together again with windows over the pages of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.plans.staging import small_side, stage

#: Letters with marks, and the letters without.
MARKED, UNMARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Single glyphs and what they are mistaken for.
GLYPHS, MEANT = "i1!|05$@+68£€¢c9", "lllloss" + "at" + "bb" + "eeee" + "g"
#: Letters that look like two others; applied in this order.
DOUBLE = (("m", "rrl"), ("n", "rl"), ("d", "el"), ("h", "ll"), ("u", "ll"), ("w", "vv"))
#: Marks at a line's end that divide a word.
DIVIDES = "-¬‐\u00ad–"
#: Digits and what they are misread as.
DIGITS_READ, DIGITS_MEANT = "OoQlIi|!SsBZzbgq", "0001111155822699"

#: Different edge lines of a document that are compared with its running lines in one task, in expectation.
SLOT = 2000
#: Roman signs and their values.
ROMAN = (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))

_DIVIDED = rf"[{DIVIDES}]\s*$"
_CODE = r"\p{Lu}(?<=\b\p{Lu})\p{Lu}{0,3}-\s*\d+\b"
_GLYPH = r"\p{L}0-9@!+$£€¢"
#: What parts tokens: other signs with the dashes behind them, or dashes and other signs, as often as they follow.
_PARTS = rf"[^{_GLYPH}ﬁﬂ\-][^{_GLYPH}ﬁﬂ]*+|(?:-++[^{_GLYPH}ﬁﬂ\-]++)++"
_NUMBER = r"(?iU)^\W*(?:(?:page|seite|página|pagina|pág|pag|p|s|blatt|folio|feuillet)\b\.?)?\W*([0-9OoQlIi|!SsBZz]{1,4})\s*(?:(?:/|of|von|de|sur|aus)\s*[0-9OoQlIi|!SsBZz]{1,4})?\W*$"
_DRESSED = r"(?iU)(?:page|seite|página|pagina|pág|pag|p\.|s\.|blatt|folio|feuillet|/|\bof\b|\bvon\b|\bde\b|\bsur\b|[\[(\-–—])"


def skeleton(word: Column) -> Column:
    """The lower-case word with glyphs that are mistaken for each other written alike."""
    out = F.replace(F.replace(F.lower(word), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    out = F.translate(F.translate(out, MARKED, UNMARKED), GLYPHS, MEANT)
    for one, two in DOUBLE:
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def _line_key(line: Column) -> Column:
    """A running line without case, digits, marks and page number, as a skeleton."""
    bare = F.regexp_replace(F.lower(line), r"(?U)(?<![\p{L}])[0-9oliszb|!]{0,3}[0-9][0-9oliszb|!]{0,3}(?![\p{L}])", " ")
    bare = F.regexp_replace(bare, r"(?iU)\b(?:page|seite|página|pagina)\b(?:\s*(?:of|von|de|sur)\b)?", " ")
    return F.regexp_replace(skeleton(bare), r"[^a-z]+", "")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, document_id, page_number, scanned, text: each page once, raw text where it was scanned and clean text elsewhere."""
    scanned = F.coalesce("used_ocr", F.lit(False))
    text = F.regexp_replace(F.when(scanned, F.col("raw_text")).otherwise(F.coalesce("cleaned_text", "raw_text")), r"\r", "")
    document = F.coalesce("document_id", F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("document_id")
    once = pages.filter("page_id is not null").groupBy("page_id").agg(F.max_by(F.struct(document, "page_number", scanned.alias("scanned"), text.alias("text")), F.struct("extracted_at", scanned, text)).alias("p"))
    return once.select("page_id", "p.*").filter("text <> ''")


def _numbered(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(r"(?U)\S"))


def _roman_value(numeral: Column) -> Column:
    """Value of a lower-case Roman numeral: each sign counts, less if a greater one follows."""
    signs = F.transform(F.split(numeral, ""), lambda c: F.create_map(*[F.lit(x) for pair in ROMAN for x in pair])[c])
    return F.aggregate(F.transform(signs, lambda v, i: F.when(v < F.coalesce(F.get(signs, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda n, v: n + v)


def running_lines(scans: DataFrame, files: DataFrame, edge: int = 3) -> DataFrame:
    """page_id, line_no, defect (header or page_no) among the first and last `edge` written lines of each page.

    header: the same key on two or more pages of the document, or one that differs from such a key by at most a quarter of its letters,
    or the insurer's name. page_no: nothing but a number that runs along with the document's pages.
    """
    written = scans.select("page_id", "document_id", "page_number", _numbered(F.col("text")).alias("w"))
    spots = F.array_distinct(F.concat(F.slice("w", 1, edge), F.when(F.size("w") > edge, F.slice("w", F.greatest(F.size("w") - edge + 1, F.lit(1)), F.lit(edge))).otherwise(F.slice("w", 1, 0))))
    edges = written.select("page_id", "document_id", "page_number", F.explode(spots).alias("e")).select("page_id", "document_id", "page_number", "e.*")
    edges = edges.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).withColumn("key", _line_key(F.col("line"))).withColumn("digits", F.regexp_extract("line", _NUMBER, 1))
    value = F.translate("digits", DIGITS_READ, DIGITS_MEANT).try_cast("int")
    number = (F.col("digits") != "") & (F.col("digits").rlike(r"\d") | F.col("line").rlike(_DRESSED))
    roman = F.lower(F.regexp_extract("line", r"(?i)^\W*(m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\W*$", 1))
    numeral = F.when(roman != "", _roman_value(roman))
    edges = stage(edges.withColumn("offsets", F.array_compact(F.array(F.when(number, value - F.col("page_number")), F.when(roman != "", numeral - F.col("page_number"))))))

    counted = edges.select("page_id", "document_id", "line_no", "line", F.explode("offsets").alias("offset"))
    support = counted.groupBy("document_id", "offset").agg(F.count_distinct("page_id").alias("pages"))
    numbers = counted.join(support, ["document_id", "offset"])
    numbers = numbers.filter((F.col("pages") >= 2) | (F.col("offset") == 0) | F.col("line").rlike(_DRESSED)).select("page_id", "line_no", F.lit("page_no").alias("defect"))

    titled = edges.filter((F.length("key") >= 4) & F.col("line").rlike(r"(?U)^[^\p{L}]*\p{Lu}|\d") & ~F.col("line").rlike(r"[^.][.,;:?!]$") & ~F.col("line").rlike(r"^\d+(?:\.\d+)+ "))
    names = files.groupBy("document_id").agg(F.max_by("insurer", F.struct("ingested_at", "insurer")).alias("insurer")).filter("insurer is not null and insurer <> 'Unknown'")
    again = titled.groupBy("document_id", "key").agg(F.count_distinct("page_id").alias("pages")).filter("pages >= 2").select("document_id", F.col("key").alias("known"))
    insurers = scans.select("document_id").distinct().join(names, "document_id").select("document_id", _line_key(F.col("insurer")).alias("known")).filter("length(known) >= 4")
    known = again.union(insurers).distinct()
    # each key of a document is compared once; the keys of a long document are dealt to slots, and its known keys meet each slot
    keys = edges.filter((F.length("key") >= 4) & ~F.col("line").rlike(r"^\d+(?:\.\d+)+ ")).select("document_id", "key", "page_id", "line_no")
    distinct = stage(keys.select("document_id", "key").distinct())
    same = distinct.join(known.withColumnRenamed("known", "key"), ["document_id", "key"])
    slots = distinct.groupBy("document_id").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    dealt = distinct.join(known.withColumnRenamed("known", "key"), ["document_id", "key"], "left_anti").join(slots, "document_id").withColumn("slot", F.pmod(F.xxhash64("key"), "slots").cast("int")).drop("slots")
    every = known.join(slots, "document_id").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    near = (F.abs(F.length("key") - F.length("known")) * 4 <= F.length("known")) & (F.levenshtein("key", "known") * 4 <= F.length("known"))
    close = dealt.join(every, ["document_id", "slot"]).filter(near).select("document_id", "key").distinct()
    headers = keys.join(same.union(close), ["document_id", "key"]).select("page_id", "line_no", F.lit("header").alias("defect")).distinct()
    return headers.union(numbers).groupBy("page_id", "line_no").agg(F.min("defect").alias("defect"))


def content_lines(scans: DataFrame, running: DataFrame) -> DataFrame:
    """page_id, line_no, line, following (the next line of text, on the next page too) with its page_id and line_no, led (the line
    before was divided), prior (the end of the line before, from its last blank on)."""
    gone = running.groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))  # at most the edge lines of a page
    page = scans.join(gone, "page_id", "left").select(
        "page_id", "document_id", "page_number",
        F.filter(_numbered(F.col("text")), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["line_no"])).alias("c"))
    page = page.filter("size(c) > 0")
    order = W.partitionBy("document_id").orderBy("page_number", "page_id")
    ends = page.select("page_id", "document_id", "page_number", F.get("c", F.lit(0)).alias("first"), F.element_at("c", -1)["line"].alias("last"))
    ends = ends.select("page_id", F.lead(F.struct("page_id", "first.line_no", "first.line")).over(order).alias("next_first"), F.lag("last").over(order).alias("prev_last"))
    lines = page.join(ends, "page_id").select(
        "page_id",
        F.explode(F.transform("c", lambda x, i: F.struct(
            x["line_no"].alias("line_no"), x["line"].alias("line"),
            F.when(i + 1 < F.size("c"), F.struct(F.col("page_id"), F.get("c", i + 1)["line_no"].alias("line_no"), F.get("c", i + 1)["line"].alias("line"))).otherwise(F.col("next_first")).alias("following"),
            F.when(i > 0, F.get("c", i - 1)["line"]).otherwise(F.col("prev_last")).alias("before")))).alias("x"))
    led = F.coalesce(F.col("x.before").rlike(_DIVIDED), F.lit(False))
    prior = F.coalesce(F.substring_index(F.rtrim("x.before"), " ", -1), F.lit(""))
    return lines.select(
        "page_id", "x.line_no", "x.line", F.col("x.following.line").alias("following"), F.col("x.following.page_id").alias("following_page"), F.col("x.following.line_no").alias("following_no"),
        led.alias("led"), F.when(led, F.lit("")).otherwise(prior).alias("prior"))


def _tokens(text: Column, parts: str = _PARTS) -> Column:
    """The lower-case words between blanks, the first and the last empty; codes are left out."""
    return F.split(F.concat(F.lit(" "), F.lower(F.regexp_replace(text, _CODE, " ")), F.lit(" ")), parts)


def _is_word(token: Column) -> Column:
    return (F.length(token) >= 2) & (token != F.upper(token))


def divided_words(lines: DataFrame) -> DataFrame:
    """page_id, line_no, mark, head, tail, following_page, following_no: a line's last word part before a dividing mark, and the next line's first."""
    cut = lines.filter(F.col("line").rlike(rf"(?U)\p{{L}}{_DIVIDED}") & F.col("following").isNotNull())
    mark = F.regexp_extract("line", rf"([{DIVIDES}])\s*$", 1)
    head = F.regexp_extract("line", rf"(?U)([{_GLYPH}ﬁﬂ\-]*[{_GLYPH}ﬁﬂ])[{DIVIDES}]\s*$", 1)
    tail = F.regexp_extract("following", rf"(?U)^\s*([{_GLYPH}ﬁﬂ]+(?:-[{_GLYPH}ﬁﬂ]+)*)", 1)
    return cut.select("page_id", "line_no", mark.alias("mark"), head.alias("head"), tail.alias("tail"), "following_page", "following_no").filter("head <> ''")


def word_forms(texts: DataFrame, divided: DataFrame) -> DataFrame:
    """prev, form, n, clean: how often each form follows each other form in all pages, and how often in pages that were not scanned.

    Forms without a small letter are left in; they are told apart once each, where the pairs have been staged.
    """
    whole = F.regexp_replace("text", rf"(?<!\S)\S++(?<=[{DIVIDES}]) *+\n\s*+\S++", " \n ")
    words = texts.select("scanned", _tokens(whole).alias("w"))
    pairs = words.select("scanned", F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("prev"), F.col("w").alias("form")))).toDF("scanned", "prev", "form")
    pairs = pairs.filter("length(form) > 1").groupBy("prev", "form").agg(F.count("*").alias("n"), F.count(F.when(~F.col("scanned"), 1)).alias("clean"))
    joined = divided.select(F.lit("").alias("prev"), F.explode(F.split(F.lower(F.concat("head", "tail")), "-")).alias("form")).filter(_is_word(F.col("form")))
    return pairs.unionByName(joined.groupBy("prev", "form").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("clean")))


def misread_forms(pairs: DataFrame, ratio: int = 4) -> DataFrame:
    """prev, form, meant, default: forms that stand for a more frequent form of the same skeleton, and what they mean after prev and in general.

    A form of letters only is misread if no clean page has it and a form of its skeleton is ratio times as frequent, or twice as
    frequent and seen after the same word. A form with digits or signs among its letters is misread if its skeleton has a form of letters,
    or if they stand between letters; what it meant is then unknown.
    """
    parts = pairs.filter("form like '%-%'").select(F.lit("").alias("prev"), F.explode(F.split("form", "-")).alias("form"), "n", "clean").filter(_is_word(F.col("form")))
    single = pairs.filter("form not like '%-%'").unionByName(parts).groupBy("prev", "form").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))
    single = stage(single.withColumn("skel", skeleton(F.col("form"))).withColumn("letters", F.col("form").rlike(r"(?U)^[\p{L}&&[^ﬁﬂ]]+$")))
    forms = single.groupBy("skel", "form", "letters").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))
    best = forms.filter("letters").groupBy("skel").agg(F.max(F.struct("n", "form")).alias("best")).select("skel", F.col("best.n").alias("best_n"), F.col("best.form").alias("best"))
    forms = forms.join(best, "skel", "left")
    odd = ~F.col("letters") & (F.col("best").isNotNull() | F.col("form").rlike(r"(?U)^\p{L}+[0-9@!+$£€¢]\p{L}+$|^[0-9@!+$£€¢]\p{Ll}{3,}$"))
    rare = F.col("letters") & (F.col("clean") == 0) & (F.col("form") != F.col("best"))
    doubt = forms.filter(odd | (rare & (F.col("n") * 2 <= F.col("best_n")))).select("form", "skel", F.col("n").alias("all_n"), "best", "best_n", "letters")
    doubt = stage(doubt)
    # what other forms of the same skeleton follow the same word
    here = single.join(doubt.select("form", "all_n", "best", "best_n"), "form").select("prev", "form", "skel", "letters", "all_n", "best", "best_n")
    there = single.filter("letters and prev <> ''").join(doubt.select("form"), "form", "left_anti").groupBy("prev", "skel").agg(F.max(F.struct("n", "form")).alias("c")).select("prev", "skel", F.col("c.form").alias("in_context"))
    told = here.join(there, ["prev", "skel"], "left")
    sure = ~F.col("letters") | (F.col("all_n") * ratio <= F.col("best_n")) | F.col("in_context").isNotNull()
    return told.filter(sure).select("prev", "form", F.coalesce("in_context", "best").alias("meant"), F.col("best").alias("default")).distinct()


def _misread_lines(lines: DataFrame, divided: DataFrame, misread: DataFrame) -> DataFrame:
    """page_id, line_no of the lines that hold a misread word; what it means in its context is not asked."""
    forms = small_side(misread.groupBy("form").agg(F.max("default").alias("default")))
    words = F.array_distinct(_tokens(_own_text(), rf"[^{_GLYPH}ﬁﬂ]+"))  # a word's parts between hyphens
    said = lines.select("page_id", "line_no", F.explode(words).alias("form")).join(forms.select("form"), "form").select("page_id", "line_no")
    return said.unionByName(_divided_misread(divided, forms).select("page_id", "line_no")).distinct()


def _own_text() -> Column:
    """A line without the parts of words that are divided at its ends."""
    text = F.regexp_replace("line", rf"(?U)\S+{_DIVIDED}", " ")
    return F.when(F.col("led"), F.regexp_replace(text, r"(?U)^\s*\S+", " ")).otherwise(text)


def _divided_misread(divided: DataFrame, general: DataFrame) -> DataFrame:
    """page_id, line_no, place, prev, form, meant of the parts of divided words that differ from the word meant.

    The part that the meant word agrees with is right; if neither is, the word is cut where the first part ends; if the meaning is not
    known, the first part is listed.
    """
    cut = divided.filter("tail <> ''").withColumn("own", F.element_at(F.split("head", "-"), -1)).withColumn("rest", F.get(F.split("tail", "-"), F.lit(0)))
    cut = cut.withColumn("form", F.lower(F.concat("own", "rest"))).join(general, "form").withColumnRenamed("default", "meant")
    own, rest, meant = F.lower("own"), F.lower("rest"), F.col("meant")
    at = F.when(meant.endswith(rest), F.length(meant) - F.length(rest)).otherwise(F.length(own))
    parts = cut.withColumn("head_meant", F.substring(meant, F.lit(1), at)).withColumn("tail_meant", F.substring(meant, at + 1, F.length(meant)))
    head = parts.filter(meant.isNull() | (F.col("head_meant") != own)).select("page_id", "line_no", F.lit("head").alias("place"), F.lit("").alias("prev"), own.alias("form"), F.col("head_meant").alias("meant"))
    tail = parts.filter(F.col("tail_meant") != rest).select(F.col("following_page").alias("page_id"), F.col("following_no").alias("line_no"), F.lit("tail").alias("place"), F.lit("").alias("prev"), rest.alias("form"), F.col("tail_meant").alias("meant"))
    return head.unionByName(tail)


def _bad_words(lines: DataFrame, divided: DataFrame, misread: DataFrame) -> DataFrame:
    """page_id, line_no, place, prev, form, meant: each misread word with the line that holds it and the word before it.

    A word means what its skeleton means after the same word, else in general. place is 'in' for whole words, 'first' for one that
    begins its line, 'head' and 'tail' for the parts of a divided word; a part is listed on its own line if it differs from the word meant.
    """
    words = F.filter(_tokens(_own_text()), lambda t: t != "")
    seen = lines.select("page_id", "line_no", "led", "prior", words.alias("w")).select("page_id", "line_no", F.explode(F.transform("w", lambda t, i: F.struct(
        F.when(i > 0, F.get("w", i - 1)).otherwise(F.coalesce(F.try_element_at(F.filter(_tokens(F.col("prior")), lambda p: p != ""), F.lit(-1)), F.lit(""))).alias("prev"), t.alias("token"), F.when((i == 0) & ~F.col("led"), "first").otherwise("in").alias("place")))).alias("x")).select("page_id", "line_no", "x.*")
    whole = F.col("token").contains("-")
    said = seen.select("page_id", "line_no", F.when(whole, "in").otherwise(F.col("place")).alias("place"), F.when(whole, "").otherwise(F.col("prev")).alias("prev"), F.explode(F.split("token", "-")).alias("form"))
    said = said.filter(_is_word(F.col("form")))
    general = misread.groupBy("form").agg(F.coalesce(F.max("default"), F.max_by("meant", F.struct(F.col("prev") != "", "meant"))).alias("default"))
    general = small_side(general)  # the measured table of misread forms; beyond the limit the join shuffles
    special = small_side(misread.filter("meant <> default and prev <> ''").groupBy("prev", "form").agg(F.max("meant").alias("meant")))
    plain = said.join(general, "form").join(special, ["prev", "form"], "left").select("page_id", "line_no", "place", "prev", "form", F.coalesce("meant", "default").alias("meant")).distinct()
    return plain.unionByName(_divided_misread(divided, general))


def _mended(line: Column, fixes: Column) -> Column:
    """The line with each misread word replaced where it stands: whole words only, after the word before it, in small letters, with a
    capital, and in capitals."""
    glyph = rf"[{_GLYPH}ﬁﬂ]"
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))

    def replace(text: Column, x: Column) -> Column:
        before = (
            F.when(x["place"] == "first", F.lit(rf"(?U)(?<=^[^{_GLYPH}]{{0,9}})"))
            .when(x["place"] == "tail", F.lit(r"(?U)(?<=^\s{0,20})"))
            .when(x["prev"] != "", F.concat(F.lit(r"(?U)(?<=(?iu:"), quoted(x["prev"]), F.lit(rf")[^{_GLYPH}]{{1,5}})")))
            .otherwise(F.lit(rf"(?U)(?<!{glyph})"))
        )
        after = F.when(x["place"] == "head", F.lit(rf"(?=[{DIVIDES}]\s*$)")).otherwise(F.lit(rf"(?!{glyph})"))
        # case by case, whatever glyph was misread: the letters around it tell the case
        out = text
        for style in (lambda c: c, F.initcap, F.upper):
            out = F.regexp_replace(out, F.concat(before, quoted(style(x["form"])), after), F.regexp_replace(style(x["meant"]), r"([\\$])", r"\\$1"))
        return out

    return F.aggregate(fixes, line, replace)


def _divisions(divided: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_id, line_no of the divided words that are written without hyphen when whole: the joined form is met at least as often."""
    met = pairs.groupBy(skeleton(F.col("form")).alias("skel")).agg(F.sum("n").alias("n"))
    word = divided.filter(F.col("tail").rlike(r"(?U)^[^0-9\p{Lu}]|^[0-9]\p{L}|^\p{Lu}{2}") & ~F.col("head").rlike(r"(?U)^\p{Lu}{2}$") & (F.length(F.regexp_replace("head", r"(?U)[^\p{L}]", "")) >= 1))
    word = word.withColumn("j", skeleton(F.concat("head", "tail"))).withColumn("h", skeleton(F.concat("head", F.lit("-"), "tail"))).withColumn("p", skeleton(F.concat(F.element_at(F.split("head", "-"), -1), F.get(F.split("tail", "-"), F.lit(0)))))
    asked = word.select(F.explode(F.array("j", "h", "p")).alias("skel")).distinct()
    found = small_side(met.join(asked, "skel"))
    count = lambda c: found.select(F.col("skel").alias(c), F.col("n").alias(f"n_{c}"))
    word = word.join(count("j"), "j", "left").join(count("h"), "h", "left").join(count("p"), "p", "left")
    # each divided word was counted once as joined itself
    whole = F.greatest(F.coalesce("n_j", F.lit(0)), F.coalesce("n_p", F.lit(0)))
    with_hyphen = F.coalesce("n_h", F.lit(0))
    divides = F.when(F.col("mark") != "-", (with_hyphen < whole) | (with_hyphen == 0)).otherwise(whole > with_hyphen)
    return word.filter(divides).select("page_id", "line_no")


def _parts(pages: DataFrame, files: DataFrame) -> tuple[DataFrame, ...]:
    texts = stage(page_texts(pages))
    scans = texts.filter("scanned")
    running = stage(running_lines(scans, files))
    lines = stage(content_lines(scans, running))
    divided = stage(divided_words(lines))
    pairs = stage(word_forms(texts, divided)).filter(_is_word(F.col("form")))
    return scans, running, lines, divided, pairs


def line_defects(pages: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, line_no, defect (header, page_no, hyphen, ocr) of the lines of scanned pages.

    Pages that were not scanned only lend their words. Null and empty texts give no rows, a page_id counts once by its latest
    extraction, pages without document_id form a document of their own, and empty tables give an empty result.
    """
    _, running, lines, divided, pairs = _parts(pages, files)
    hyphen = _divisions(divided, pairs).withColumn("defect", F.lit("hyphen"))
    ocr = _misread_lines(lines, divided, misread_forms(pairs)).withColumn("defect", F.lit("ocr"))
    return running.unionByName(hyphen).unionByName(ocr)


def repaired_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, cleaned_text: each scanned page as paragraphs parted by an empty line, without running lines, with divided and
    misread words restored. A paragraph that goes on overleaf stands whole on the page where it begins."""
    scans, running, lines, divided, pairs = _parts(pages, files)
    joins = _divisions(divided, pairs).withColumn("glue", F.lit(True))
    bad = _bad_words(lines, divided, misread_forms(pairs)).filter("meant is not null")
    # the word before it matters only where one line holds the form with two meanings
    fixes = F.collect_set(F.struct("place", "prev", "form", "meant"))
    bad = bad.withColumn("part", F.when(F.col("place").isin("head", "tail"), F.col("place")).otherwise("in")).groupBy("page_id", "line_no", "part", "form").agg(F.count_distinct("meant").alias("meanings"), F.min("meant").alias("meant"), fixes.alias("fixes"))
    bad = bad.withColumn("fixes", F.when(F.col("meanings") > 1, F.col("fixes")).otherwise(F.array(F.struct(F.col("part").alias("place"), F.lit("").alias("prev"), "form", "meant"))))
    bad = bad.groupBy("page_id", "line_no").agg(F.sort_array(F.flatten(F.collect_list("fixes"))).alias("fixes"))
    blank = scans.select("page_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).filter(~F.col("t").rlike(r"(?U)\S")).select("page_id", (F.col("i") + 2).alias("line_no"), F.lit(True).alias("after_blank"))
    one = lines.join(joins, ["page_id", "line_no"], "left").join(bad, ["page_id", "line_no"], "left").join(blank, ["page_id", "line_no"], "left")
    fixed = F.when(F.col("fixes").isNull(), F.col("line")).otherwise(_mended(F.col("line"), F.col("fixes")))
    clean = F.regexp_replace(F.regexp_replace(fixed, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    clean = F.when(F.col("glue"), F.regexp_replace(clean, _DIVIDED, "")).otherwise(F.concat(clean, F.when(F.col("line").rlike(_DIVIDED), F.lit("")).otherwise(F.lit(" "))))
    heading = F.col("line").rlike(r"^\s*\d+(?:\.\d+)+ \S")
    starts = F.col("after_blank").isNotNull() | F.col("line").rlike(r"(?U)^\s{2,}\S") | heading
    one = one.select("page_id", "line_no", F.when(heading, F.concat(F.trim(clean), F.lit("\n\n"))).otherwise(clean).alias("t"), starts.alias("starts"))
    page = one.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "t", "starts"))).alias("l")).join(scans.select("page_id", "document_id", "page_number"), "page_id")
    first = F.coalesce(F.array_min(F.transform(F.filter("l", lambda x: x["starts"]), lambda x: x["line_no"])), F.lit(2**30))
    body = lambda ls: F.array_join(F.transform(ls, lambda x: F.concat(F.when(x["starts"], F.lit("\n\n")).otherwise(F.lit("")), x["t"])), "")
    page = page.withColumn("first", first).select("page_id", "document_id", "page_number", (F.col("first") < 2**30).alias("has_start"),
        body(F.filter("l", lambda x: x["line_no"] < F.col("first"))).alias("lead"), body(F.filter("l", lambda x: x["line_no"] >= F.col("first"))).alias("rest"))
    order = W.partitionBy("document_id").orderBy("page_number", "page_id")
    page = page.withColumn("opens", F.col("has_start") | F.lag("page_id").over(order).isNull())
    page = stage(page.withColumn("home", F.sum(F.col("opens").cast("int")).over(order)))
    # a page's lead goes to the home before its own, unless the page is the document's first
    leads = page.select("document_id", "page_number", "page_id", F.when(F.col("has_start") & (F.col("home") > 1), F.col("home") - 1).otherwise(F.col("home")).alias("home"), F.col("lead").alias("t"))
    rests = page.filter("has_start").select("document_id", "page_number", "page_id", "home", F.col("rest").alias("t"))
    whole = leads.unionByName(rests).groupBy("document_id", "home").agg(F.sort_array(F.collect_list(F.struct("page_number", "page_id", "t"))).alias("ts"))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("ts", lambda x: x["t"]), ""), r" *\n\n[\n ]*", "\n\n"), r"^\s+|\s+$", "")
    made = page.filter("opens").select("page_id", "document_id", "home").join(whole, ["document_id", "home"]).select("page_id", text.alias("cleaned_text"))
    return scans.select("page_id").join(made, "page_id", "left").select("page_id", F.coalesce("cleaned_text", F.lit("")).alias("cleaned_text"))
