"""From positioned characters and lines to titles and outlines.

Lines carry doc_id, page (0-based), line_no (document order), text, font_size,
is_bold, position, y_position and height. A document's lines stem from one
file, so windows over a document stay bounded by it; nothing is windowed over
a session or a whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.headings import (
    ends_sentence, is_body_like, is_definite_body, is_form_field, is_likely_heading,
    is_numbered, is_running_line, is_running_text, matches_heading_pattern, numbering,
)
from quire.functions.text import (
    clean_heading, clean_title, col, collapse_repeats, contains_any, count_text,
    ends_with_any, is_title, is_upper, jaccard_words, matches_any, starts_lower,
    starts_upper, strip, whole_word, words,
)

INF = float("inf")


def by_document():
    return Window.partitionBy("doc_id").orderBy("line_no")


def by_page():
    return Window.partitionBy("doc_id", "page").orderBy("line_no")


# --- characters to lines ------------------------------------------------------------

def chars_to_lines(chars: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Give each character its line: a new one where ``top`` jumps too far."""
    by_place = Window.partitionBy("doc_id", "page").orderBy("top", "x0", "text")
    jump = F.abs(F.col("top") - F.lag("top").over(by_place)) > tolerance
    numbered = chars.withColumn("_new", F.coalesce(jump, F.lit(False)).cast("int"))
    running = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("line_no", F.sum("_new").over(running).cast("int")).drop("_new")


def _page_lines(page: pa.Table) -> pa.Table:
    """One row per line of a page's characters: its text put together, and what its place is told from."""
    column = {c: page.column(c).combine_chunks() for c in page.column_names}

    def number(c: str) -> np.ndarray:
        return pc.fill_null(column[c].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)

    line = column["line_no"].to_numpy(zero_copy_only=False)
    numbers, own = np.unique(line, return_inverse=True)
    n = len(numbers)

    def mean(values: np.ndarray, of: np.ndarray) -> pa.Array:
        many = np.bincount(own[of], minlength=n)
        total = np.bincount(own[of], values[of], minlength=n)
        return pa.array(total / np.maximum(many, 1), pa.float64(), mask=many == 0)

    def ends(ufunc: np.ufunc, start: float) -> np.ndarray:
        out = np.full(n, start)
        for values in (x0, x1):
            ufunc.at(out, own[~np.isnan(values)], values[~np.isnan(values)])
        return out

    x0, x1, size, top, height = (number(c) for c in ("x0", "x1", "size", "top", "height"))
    visible = pc.fill_null(column["visible"], False).to_numpy(zero_copy_only=False)
    bold = pc.fill_null(column["bold"].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    left, right = ends(np.minimum, np.inf), ends(np.maximum, -np.inf)

    shown = np.flatnonzero(pc.fill_null(pc.not_equal(column["text"], ""), False).to_numpy(zero_copy_only=False))
    texts = column["text"].take(pa.array(shown))
    low = np.where(np.isnan(x0), -np.inf, x0)[shown]
    order = np.lexsort((low, own[shown]))
    if ((np.diff(own[shown][order]) == 0) & (np.diff(low[order]) == 0)).any():  # characters of one place go by their text
        place = pa.table({"line": own[shown], "x0": low, "text": texts, "x1": np.where(np.isnan(x1), -np.inf, x1)[shown]})
        order = pc.sort_indices(place, [(c, "ascending") for c in place.column_names]).to_numpy()
    at, texts = shown[order], texts.take(pa.array(order))
    new = np.r_[True, np.diff(own[at]) != 0] if len(at) else np.zeros(0, bool)
    keep, last = np.ones(len(at), bool), np.maximum(np.arange(len(at)) - 1, 0)
    same = pc.equal(texts, texts.take(pa.array(last))).to_numpy(zero_copy_only=False)
    # a repeated print can only follow on one of the same text: few to look at one by one
    kept = -1
    for i in np.flatnonzero(~new & same & (np.abs(x0[at] - x0[at[last]]) < 1)) if len(at) else ():
        kept = kept if kept >= 0 and not keep[i - 1] else i - 1
        keep[i] = not abs(x0[at[i]] - x0[at[kept]]) < 1
        kept = -1 if keep[i] else kept
    at, texts, new = at[keep], texts.filter(pa.array(keep)), new[keep]
    last = np.maximum(np.arange(len(at)) - 1, 0)
    gap = ~new & (x0[at] - x1[at[last]] > 3)
    texts = pc.binary_join_element_wise(pa.array(np.where(gap, " ", ""), pa.string()), texts.cast(pa.string()), "")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(own[at], minlength=n))))
    raw = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), texts), "")
    first = np.zeros(n, np.int64)
    return pa.table({
        "doc_id": column["doc_id"].take(pa.array(first)), "page": column["page"].take(pa.array(first)), "line_no": pa.array(numbers, column["line_no"].type),
        "raw_text": raw, "font_size": mean(size, visible & ~np.isnan(size)), "is_bold": pc.greater(mean(bold, ~np.isnan(bold)), 0.5),
        "_left": mean(x0, ~np.isnan(x0)), "_width": pa.array(right - left, pa.float64(), mask=~np.isfinite(right - left)),
        "y_position": mean(top, ~np.isnan(top)), "height": mean(height, ~np.isnan(height) & (height != 0)),
    })


def line_metrics(placed: DataFrame) -> DataFrame:
    """Text, mean size, boldness, position and place of each line of characters.

    A character printed twice in one spot counts once in the text; a gap of
    more than 3 becomes a blank. A page's characters are one group of columns,
    in the partitioning and order that ``chars_to_lines`` left them.
    """
    keys = ["doc_id", "page", "line_no"]
    kinds = dict(placed.dtypes)
    grouped = placed.select(
        *keys, "text", "x0", "x1", "top", "size", "height",
        F.lower("fontname").contains("bold").alias("bold"), (strip("text") != "").alias("visible"),
    ).groupBy("doc_id", "page").applyInArrow(
        _page_lines,
        ", ".join(f"{k} {kinds[k]}" for k in keys)
        + ", raw_text string, font_size double, is_bold boolean, _left double, _width double, y_position double, height double",
    )
    position = (
        F.when(F.col("_left") < F.col("_width") * 0.15, "left")
        .when(F.col("_left") > F.col("_width") * 0.70, "right").otherwise("center")
    )
    return (
        grouped.withColumn("raw_text", strip("raw_text"))
        .select(
            *keys, "raw_text", collapse_repeats("raw_text").alias("text"),
            F.coalesce("font_size", F.lit(12.0)).alias("font_size"), "is_bold", position.alias("position"),
            "y_position", F.coalesce("height", F.lit(14.0)).alias("height"),
        )
        .where("raw_text <> ''")
    )


def font_stats(chars: DataFrame) -> DataFrame:
    """Mean and largest size and share of bold per page."""
    visible = chars.where(strip("text") != "")
    return visible.groupBy("doc_id", "page").agg(
        F.avg("size").alias("avg_size"), F.max("size").alias("max_size"),
        F.avg(F.lower("fontname").contains("bold").cast("double")).alias("bold_ratio"),
    )


def line_font_stats(lines: DataFrame) -> DataFrame:
    """The same from lines, each weighing as many characters as it shows."""
    n = F.length(F.regexp_replace("text", r"\s+", ""))
    return lines.groupBy("doc_id", "page").agg(
        (F.sum(F.col("font_size") * n) / F.sum(n)).alias("avg_size"),
        F.max("font_size").alias("max_size"),
        (F.sum(F.when(F.col("is_bold"), n).otherwise(0)) / F.sum(n)).alias("bold_ratio"),
    )


# --- outline and title by fonts ------------------------------------------------------

def _font_key(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("text") >= 3).withColumn("font", F.round("font_size", 1))


def body_and_heading_fonts(lines: DataFrame) -> DataFrame:
    """Per document: fonts above body, by how often they occur, as levels.

    The most frequent (size, bold) is body; ties go to the font met first.
    """
    counted = _font_key(lines).groupBy("doc_id", "font", "is_bold").agg(
        F.count("*").alias("uses"), F.min("line_no").alias("first")
    )
    by_use = Window.partitionBy("doc_id").orderBy(F.col("uses").desc(), F.col("first").asc())
    ranked = counted.withColumn("r", F.row_number().over(by_use))
    body = ranked.where("r = 1").select("doc_id", F.col("font").alias("body"), F.col("is_bold").alias("body_bold"))
    above = ranked.join(body, "doc_id").where(
        (F.col("font") > F.col("body"))
        | ((F.col("font") == F.col("body")) & F.col("is_bold") & ~F.col("body_bold"))
    )
    level = Window.partitionBy("doc_id").orderBy("r")
    return above.withColumn("level", F.row_number().over(level)).select(
        "doc_id", "font", "is_bold", "uses", "level", "body", "body_bold"
    )


def outline_by_font(lines: DataFrame) -> DataFrame:
    """Lines in heading fonts that read like headings; level by font, up to 6."""
    fonts = body_and_heading_fonts(lines).where("level <= 6").select("doc_id", "font", "is_bold", "level")
    return (
        _font_key(lines).join(fonts, ["doc_id", "font", "is_bold"]).where(is_likely_heading("text"))
        .select("doc_id", "page", "line_no", "y_position", "level", "text")
    )


def outline_from_toc(toc: DataFrame, lines: DataFrame) -> DataFrame:
    """The embedded table of contents where it has more than two entries, else fonts.

    ``toc``: doc_id, entry_no, level, title, page (1-based).
    """
    sizes = toc.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 2").select("doc_id")
    listed = toc.join(sizes, "doc_id", "left_semi").select(
        "doc_id", F.greatest(F.col("page") - 1, F.lit(0)).alias("page"), F.col("entry_no").alias("line_no"),
        "level", strip("title").alias("text"),
    )
    found = outline_by_font(lines).select("doc_id", "page", "line_no", "level", "text").join(sizes, "doc_id", "left_anti")
    return listed.unionByName(found)


def title_by_font(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Metadata title, else the first fitting text in the largest font of page one."""
    first = lines.where((F.col("page") == 0) & (F.length(strip("text")) > 3))
    top = first.groupBy("doc_id").agg(F.max("font_size").alias("top"))
    largest = first.join(top, "doc_id").where(F.col("font_size") == F.col("top"))
    t = strip("text")
    good = (F.length(t) > 10) & ~is_running_text(t)
    found = largest.groupBy("doc_id").agg(
        F.min_by(t, F.when(good, F.col("line_no"))).alias("good"), F.min_by(t, "line_no").alias("any")
    )
    if metadata is None:
        return found.select("doc_id", F.coalesce("good", "any").alias("title"))
    given = metadata.where(F.length(strip("title")) > 3).select("doc_id", strip("title").alias("given"))
    return found.join(given, "doc_id", "full_outer").select("doc_id", F.coalesce("given", "good", "any").alias("title"))


# --- title by several strategies -------------------------------------------------------

def _first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of page one of each document, with their order."""
    place = F.row_number().over(by_page())
    return lines.where("page = 0").withColumn("place", place).where(F.col("place") <= n)


def _whitespace(lines: DataFrame, over) -> DataFrame:
    above = F.abs(F.col("y_position") - (F.lag("y_position").over(over) + F.lag("height").over(over)))
    below = F.abs(F.lead("y_position").over(over) - (F.col("y_position") + F.col("height")))
    return lines.withColumn("above", F.coalesce(above, F.lit(INF))).withColumn("below", F.coalesce(below, F.lit(INF)))


def _not_furniture(t: Column) -> Column:
    return ~is_running_line(t) & ~is_form_field(t)


def prominent_line_groups(lines: DataFrame) -> DataFrame:
    """Scored groups of neighbouring lines in the top fifth of sizes.

    Looks at the first 15 lines of page one; lines less than 30 apart group.
    """
    first = _first_lines(lines, 15).withColumn("t", strip("text"))
    by_size = Window.partitionBy("doc_id").orderBy(F.col("font_size").desc(), F.col("place").asc())
    ranked = first.where("t <> ''").withColumn("r", F.row_number().over(by_size))
    n = ranked.groupBy("doc_id").agg(F.greatest(F.floor(F.count("*") / 5), F.lit(1)).alias("at"))
    limit = ranked.join(n, "doc_id").where("r = at").select("doc_id", F.col("font_size").alias("limit"))
    kept = ranked.join(limit, "doc_id").where(
        (F.length("t") > 2) & (F.length("t") < 200) & (F.col("font_size") >= F.col("limit")) & _not_furniture(F.col("t"))
    )
    order = Window.partitionBy("doc_id").orderBy("place")
    new = F.coalesce((F.abs(F.col("y_position") - F.lag("y_position").over(order)) >= 30).cast("int"), F.lit(0))
    grouped = kept.withColumn("_new", new).withColumn(
        "group_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    size, bold = F.count("*"), F.sum(F.col("is_bold").cast("int"))
    spread = F.max("font_size") - F.min("font_size")
    score = (
        F.avg("font_size") * 0.5
        + F.when(F.min((F.col("position") == "center").cast("int")) == 1, 15.0)
        .when(F.min((F.col("position") == "left").cast("int")) == 1, 5.0).otherwise(0.0)
        + F.when(bold == size, 10.0).when(bold == 0, 5.0).otherwise(0.0)
        + F.when(size == 1, -5.0).when(size.isin(2, 3), 8.0).when(size == 4, 3.0).otherwise(-10.0)
        + F.when(spread <= 1.0, 8.0).when(spread <= 2.0, 4.0).otherwise(0.0)
    )
    members = F.array_sort(F.collect_list(F.struct("place", "t")))
    return grouped.groupBy("doc_id", "group_no").agg(
        score.alias("score"), size.alias("line_count"), spread.alias("spread"),
        F.avg("font_size").alias("font_size"), F.min("y_position").alias("y_position"),
        F.max("y_position").alias("y_position_end"), F.transform(members, lambda m: m["t"]).alias("group_lines"),
    ).withColumn("text", clean_title(F.array_join("group_lines", " ")))


def title_candidates(lines: DataFrame, multiline: bool = False) -> DataFrame:
    """One candidate per strategy: method, confidence, text and its line.

    Largest font 0.9, pattern 0.8, isolation 0.7, centred 0.6; grouped lines
    0.95 when ``multiline`` is on (the published behaviour never reaches it).
    """
    first = _whitespace(lines.where("page = 0"), by_page()).withColumn("place", F.row_number().over(by_page())).where("place <= 15")
    t = strip("text")
    fits = _not_furniture(t)
    place = F.col("place")

    n = F.length(t)
    ten = place <= 10
    tests = [
        ("max_font", 0.9, (n > 3) & (n < 200) & fits, F.struct(-F.col("font_size"), place)),
        ("pattern", 0.8, ten & (n > 10) & (n < 100) & matches_any(t, V.TITLE_PATTERNS) & fits, F.struct(place)),
        ("context", 0.7, ten & (n > 5) & (n < 150) & fits & (F.col("above") > 25) & (F.col("below") > 15), F.struct(place)),
        ("center", 0.6, ten & (n > 5) & (n < 150) & fits & (F.col("position") == "center"), F.struct(place)),
    ]
    line = F.struct(t.alias("text"), "font_size", "y_position")
    best = first.groupBy("doc_id").agg(*[F.min_by(line, F.when(test, order)).alias(name) for name, _, test, order in tests])
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("method"), F.lit(confidence).alias("confidence"), F.col(f"{name}.text").alias("text"),
                F.col(f"{name}.font_size").alias("font_size"), F.col(f"{name}.y_position").alias("y_position"),
            )
            for name, confidence, _, _ in tests
        ]
    )
    found = best.select("doc_id", F.explode(listed).alias("c")).select(
        "doc_id", "c.*", F.lit(None).cast("array<string>").alias("group_lines")
    ).where("text is not null")
    if multiline:
        groups = prominent_line_groups(lines).where("line_count between 2 and 5 and spread <= 2.0 and score > 0 and text <> ''")
        best = groups.groupBy("doc_id").agg(
            F.max_by(F.struct("text", "font_size", "y_position", "group_lines"), F.struct("score", -F.col("group_no"))).alias("b")
        )
        found = found.unionByName(
            best.select(
                "doc_id", F.lit("multiline").alias("method"), F.lit(0.95).alias("confidence"),
                "b.text", "b.font_size", "b.y_position", "b.group_lines",
            )
        )
    return found


def best_title(lines: DataFrame, multiline: bool = False) -> DataFrame:
    """The candidate of highest confidence, cleaned; empty where there is none."""
    best = title_candidates(lines, multiline).groupBy("doc_id").agg(
        F.max_by(F.struct("text", "method", "confidence", "font_size", "y_position", "group_lines"), "confidence").alias("b")
    )
    docs = lines.select("doc_id").distinct()
    return docs.join(best, "doc_id", "left").select(
        "doc_id", F.coalesce(clean_title(F.col("b.text")), F.lit("")).alias("title"),
        F.col("b.method").alias("title_method"), F.col("b.confidence").alias("title_confidence"),
        F.col("b.font_size").alias("title_size"), F.col("b.y_position").alias("title_y"), F.col("b.group_lines").alias("group_lines"),
    )


def prominence(lines: DataFrame) -> DataFrame:
    """Size against the page mean, times bonuses for centre, bold and length."""
    means = lines.where(strip("text") != "").groupBy("doc_id", "page").agg(F.avg("font_size").alias("mean_size"))
    n = F.length(strip("text"))
    score = (
        F.col("font_size") / F.coalesce("mean_size", F.lit(12.0))
        * F.when(F.col("position") == "center", 1.2).otherwise(1.0)
        * F.when(F.col("is_bold"), 1.3).otherwise(1.0)
        * F.when(n.between(10, 150), 1.2).when(n > 150, 0.8).otherwise(1.0)
    )
    return lines.join(means, ["doc_id", "page"], "left").withColumn("prominence", score).drop("mean_size")


def title_by_prominence(lines: DataFrame) -> DataFrame:
    t = strip("text")
    fit = prominence(lines.where("page = 0")).where((F.length(t) > 3) & _not_furniture(t))
    return fit.groupBy("doc_id").agg(
        F.min_by(t, F.struct(-F.round("prominence", 9), "line_no")).alias("title")
    )


# --- heading candidates -----------------------------------------------------------------

def is_form_document(lines: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Documents where over a fifth of the lines look like form fields."""
    t = strip("text")
    form = (
        t.rlike(r"^\d+\.\s+[A-Z]") | contains_any(t, V.FORM_DOCUMENT_PHRASES)
        | (t.contains("Age") & t.contains("Name"))
    )
    shares = lines.where(F.length(t) > 3).groupBy("doc_id").agg(F.avg(form.cast("double")).alias("form_share"))
    if titles is None:
        return shares.withColumn("is_form", F.col("form_share") > 0.2)
    joined = shares.join(titles.select("doc_id", "title"), "doc_id", "left")
    named = F.coalesce(F.lower("title").contains("application form"), F.lit(False))
    return joined.withColumn("is_form", (F.col("form_share") > 0.2) | named).drop("title")


def _looks_like_table_row(t: Column) -> Column:
    ws = words(t)
    n = F.size(ws)
    headers = F.size(F.array_intersect(words(F.lower(t)), F.array(*[F.lit(h) for h in V.TABLE_HEADERS])))
    numbered = ws[0].rlike(r"^\d+\.?")
    rest = F.when(numbered, F.slice(ws, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(ws)
    short_capital = F.size(F.filter(rest, lambda w: (F.length(w) <= 10) & starts_upper(w)))
    return (n >= 3) & ((headers >= 2) | ((n >= 4) & (F.size(rest) >= 3) & (short_capital >= 3)))


def _looks_like_list_item(t: Column) -> Column:
    ws = words(F.lower(t))
    common = F.size(F.filter(ws, lambda w: w.isin(V.SENTENCE_WORDS)))
    return (
        (F.length(t) > 150)
        | (ends_with_any(t, ".,;") & (F.length(t) > 50))
        | ((F.size(ws) > 10) & (common > F.size(ws) * 0.3))
    )


def _has_title_words(t: Column) -> Column:
    ws = words(t)
    n = F.size(ws)
    rest = F.slice(ws, F.lit(2), F.greatest(n - 1, F.lit(0)))
    capital = F.size(F.filter(rest, lambda w: starts_upper(w)))
    return F.length(t).between(5, 100) & (
        contains_any(F.lower(t), V.TITLE_WORDS) | ((n >= 2) & (capital >= (n - 1) * 0.7))
    )


def _is_body_text(t: Column, size: Column, avg: Column) -> Column:
    low = F.lower(t)
    signs = (
        low.rlike(r"^[a-z][a-z].+[.!?]\s+[a-z][a-z]").cast("int")
        + low.rlike(whole_word(V.BODY_VERBS)).cast("int")
        + low.rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(V.BODY_PREPOSITIONS) + r")\s+the(?:[^\p{L}\p{N}_]|$)").cast("int")
        + low.rlike(whole_word(V.BODY_EXAMPLES)).cast("int")
    )
    return is_body_like(t) | (signs >= 2) | (size < avg * 0.9)


def heading_candidates(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """Lines that may be headings, by numbering, wording, type and place."""
    t, size, bold, position = strip("text"), F.col("font_size"), F.col("is_bold"), F.col("position")
    avg, top = F.col("avg_size"), F.col("max_size")
    n = F.length(t)
    rejected = (
        (n < 3) | (n > 200)
        | is_running_line(t)
        | matches_any(t, V.FORM_ROW_PATTERNS)
        | t.rlike(r"\.\s*\d+\s*$")
        | ((F.size(words(t)) <= 2) & (n < 20) & ~t.rlike(r"^\d+\."))
        | _is_body_text(t, size, avg)
    )
    spacing = (n <= 120) & ~(ends_sentence(t) & (n > 30))
    numbered_ok = (
        ~_looks_like_table_row(t) & ~_looks_like_list_item(t) & ~matches_any(F.lower(t), V.FORM_LIST_PATTERNS)
        & ((size >= avg * 1.05) | bold | spacing | position.isin("center", "left") | _has_title_words(t))
    )
    span = top - avg
    first = F.when(span < 2, avg * 1.2).otherwise(avg + span * 0.4)
    second = F.when(span < 2, avg * 1.15).otherwise(avg + span * 0.25)
    third = F.when(span < 2, avg * 1.1).otherwise(avg + span * 0.1)
    type_ok = (
        (size >= first) | (size >= second) | (bold & (size >= avg * 1.05)) | ((size >= third) & bold) | (bold & (size >= avg))
    )
    place_ok = (
        (size > avg * 1.05) & (n <= 120) & ~(t.endswith(".") & (n > 50)) & (n < 100)
        & (((position == "left") & (size >= avg * 1.08)) | (position == "center"))
    )
    accepted = F.when(is_numbered(t), numbered_ok).otherwise(matches_heading_pattern(t) | type_ok | place_ok)
    return lines.join(stats, ["doc_id", "page"]).where(~rejected & accepted).withColumn("text", t)


def raw_level(candidates: DataFrame) -> DataFrame:
    """Numbering depth, else visual rules; 1 is the highest level."""
    t, size, bold = strip("text"), F.col("font_size"), F.col("is_bold")
    avg, top, centre = F.col("avg_size"), F.col("max_size"), F.col("position") == "center"
    ratio = size / avg
    visual = (
        F.when(t.endswith(":") & (F.length(t) <= 25) & (F.size(words(t)) <= 3), 3)
        .when(t.endswith("?") | F.lower(t).rlike(whole_word([r"could\s+mean"])), 4)
        .when(centre & (size >= avg * 1.3), 1)
        .when((size >= top * 0.8) | (centre & (size >= avg * 1.2)), 1)
        .when(ratio >= 1.3, 1).when(ratio >= 1.2, 2).when((ratio >= 1.1) | bold, 3).otherwise(4)
    )
    return candidates.withColumn("raw_level", F.coalesce(numbering(t)["depth"], visual).cast("int"))


def spatial_headings(lines: DataFrame) -> DataFrame:
    """Lines set apart above more than below and followed by body text."""
    t = F.col("t")
    spaced = _whitespace(lines.withColumn("t", strip("text")), by_document())
    body = is_definite_body(t)
    heads = (F.length(t) < 100) & ~t.endswith(".") & (F.col("font_size") >= 11) & ~is_body_like(t)
    kind = F.when(t == "", "").when(body, "b").when(heads, "h").otherwise("-")
    ahead = F.collect_list("kind").over(by_document().rowsBetween(1, 5))
    near = by_document().rowsBetween(1, 3)
    visible = F.when(t != "", F.col("font_size"))
    marked = (
        spaced.withColumn("kind", kind)
        .withColumn("followed", F.array_join(ahead, "").rlike("^-*b"))
        .withColumn("next_size", F.avg(visible).over(near))
    )
    n = F.length(t)
    furniture = matches_any(F.lower(t), V.SPATIAL_RUNNING_PATTERNS)
    worded = (
        n.between(3, 120) & ~ends_sentence(t) & (count_text(t, ".") <= 1) & (count_text(t, ",") <= 3)
        & t.rlike(r"^[\p{Lu}\p{Nd}]")
    )
    apart = (F.col("above") >= 20) & (F.col("below") >= 10) & (F.col("above") > F.col("below"))
    growth = F.coalesce(F.least(F.col("font_size") / F.col("next_size") - 1.0, F.lit(1.0)), F.lit(0.0))
    confidence = F.least(
        F.when(F.col("above") > F.col("below") * 1.5, 0.3).otherwise(0.0)
        + growth * 0.2
        + F.when(n.between(5, 80), 0.2).when(n <= 120, 0.1).otherwise(0.0)
        + F.when(F.col("is_bold"), 0.15).otherwise(0.0)
        + F.when(F.col("position").isin("left", "center"), 0.1).otherwise(0.0)
        + F.when(F.col("followed"), 0.25).otherwise(0.0),
        F.lit(1.0),
    )
    return (
        marked.where((n >= 3) & (n <= 200) & ~is_body_like(t) & ~furniture & apart & F.col("followed") & worded)
        .withColumn("confidence", confidence).where(F.round("confidence", 9) > 0.6)
        .withColumn("raw_level", context_level("font_size", "is_bold", "above"))
        .drop("t", "kind", "followed", "next_size")
    )


def context_level(size, bold, above) -> Column:
    """Level from size and weight, one up after a large gap."""
    s, b = col(size), col(bold)
    level = (
        F.when((s >= 16) | (b & (s >= 14)), 1).when((s >= 14) | (b & (s >= 12)), 2)
        .when((s >= 12) | b, 3).otherwise(4)
    )
    return F.when(col(above) > 40, F.greatest(level - 1, F.lit(1))).otherwise(level).cast("int")


HEADING = ["doc_id", "page", "line_no", "text", "font_size", "is_bold", "position", "raw_level", "y_position"]


def merge_candidates(traditional: DataFrame, spatial: DataFrame) -> DataFrame:
    """Both lists, one entry per (lower-case text, page).

    The first list wins over the second; without a confidence of its own it
    counts as 0.5.
    """
    a = traditional.select(*HEADING, F.lit(0.5).alias("confidence"), F.lit(0).alias("_list"))
    b = spatial.select(*HEADING, "confidence", F.lit(1).alias("_list"))
    key = F.lower(strip("text"))
    entry = F.struct(*HEADING, "confidence", "_list")
    order = F.struct("_list", -F.col("confidence"), "line_no")
    kept = a.unionByName(b).groupBy("doc_id", "page", key.alias("_key")).agg(F.min_by(entry, order).alias("e"))
    return kept.select("e.*").withColumn(
        "detection_method", F.when(F.col("_list") == 1, "spatial_context").otherwise("traditional")
    ).drop("_list")


def sequential_groups(headings: DataFrame) -> DataFrame:
    """Runs of headings within 50 of each other on a page; members 1-4 get H1-H4."""
    order = Window.partitionBy("doc_id", "page").orderBy("y_position", "line_no")
    far = F.coalesce((F.abs(F.col("y_position") - F.lag("y_position").over(order)) > 50).cast("int"), F.lit(0))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = headings.withColumn("_far", far).withColumn("run", F.sum("_far").over(running))
    in_run = Window.partitionBy("doc_id", "page", "run")
    place = F.row_number().over(in_run.orderBy("y_position", "line_no"))
    size = F.count("*").over(in_run)
    return grouped.withColumn("_place", place).withColumn("_size", size).withColumn(
        "sequential_level",
        F.when((F.col("_size") > 1) & (F.col("_place") <= 4), F.concat(F.lit("H"), F.col("_place").cast("string"))),
    ).drop("_far", "_place", "_size")


def spacing_percentiles(lines: DataFrame) -> DataFrame:
    """Nearest-rank 50/75/90/95 % of the gaps between lines of a page, per document."""
    gap = F.abs(F.lead("y_position").over(by_page()) - (F.col("y_position") + F.col("height")))
    gaps = lines.withColumn("gap", gap)
    ordered = Window.partitionBy("doc_id").orderBy("gap", "line_no")
    ranked = gaps.where("gap is not null").withColumn("r", F.row_number().over(ordered))
    sizes = gaps.groupBy("doc_id").agg(F.count("gap").alias("n"))

    def at(share: float, default: float) -> Column:
        hit = F.max(F.when(F.col("r") == F.floor(F.col("n") * share) + 1, F.col("gap")))
        return F.coalesce(hit, F.lit(default)).alias(f"p{round(share * 100)}")

    return sizes.join(ranked.select("doc_id", "r", "gap"), "doc_id", "left").groupBy("doc_id").agg(
        at(0.5, 5.0), at(0.75, 10.0), at(0.9, 20.0), at(0.95, 30.0)
    )


def _page_context(lines: DataFrame) -> DataFrame:
    """The first line of each text on a page with its neighbours and gaps."""
    t = strip("text")
    around = (
        _whitespace(lines, by_page())
        .withColumn("before", F.lag(t).over(by_page())).withColumn("after", F.lead(t).over(by_page()))
    )
    entry = F.struct("above", "below", "before", "after", F.col("font_size").alias("line_size"), F.col("is_bold").alias("line_bold"))
    return around.groupBy("doc_id", "page", t.alias("text")).agg(F.min_by(entry, "line_no").alias("c")).select(
        "doc_id", "page", "text", "c.*"
    )


def isolation_filter(headings: DataFrame, lines: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Keep headings with strong evidence, or set apart from the text around."""
    t, n = F.col("text"), F.length("text")
    size, bold = F.col("line_size"), F.col("line_bold")
    strong = (
        is_numbered(t) | (bold & (size >= 12)) | ((n <= 15) & (bold | (size >= 13))) | matches_heading_pattern(t)
        | t.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]+.*\([A-Za-z\s]+\)")
    )
    sound = (
        (n >= 2) & (n <= 120) & ~is_body_like(t) & ~(ends_sentence(t) & (n > 30))
        & ~contains_any(F.lower(t), V.PARAGRAPH_WORDS)
    )
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    flows = F.lower(t).rlike("^(?:" + "|".join(V.FLOW_WORDS) + ") ")
    continued = (
        F.col("before").isNotNull()
        & (((before != "") & ~ends_with_any(before, ".!?:")) | starts_lower(t) | flows)
    ) | (F.col("after").isNotNull() & ~ends_with_any(t, ".!?:") & starts_lower(after))
    weight = F.when(bold, 2.0).otherwise(0.0) + F.when(size >= 14, 1.0).when(size >= 13, 0.5).otherwise(0.0)
    needed = F.when(weight >= 2, F.col("p50")).when(weight >= 1, F.col("p75")).otherwise(F.col("p90"))
    up, down = F.col("above") >= needed, F.col("below") >= needed
    spaced = F.when(n <= 10, up & down).otherwise(
        up | down | ((F.col("above") >= F.col("p50")) & (F.col("below") >= F.col("p50")))
    )
    placed = (
        headings.withColumn("text", strip("text"))
        .join(_page_context(lines), ["doc_id", "page", "text"]).join(percentiles, "doc_id")
    )
    return placed.where(strong | (sound & ~continued & spaced)).select(*headings.columns)


def major_headings(headings: DataFrame) -> DataFrame:
    """Keep what qualifies as one of the three upper levels."""
    t, n = strip("text"), F.length(strip("text"))
    low = F.lower(t)
    blanks = count_text(t, " ")
    described = (
        ((n > 80) & ((blanks > 12) | (count_text(t, ",") > 2)))
        | (t.rlike(r"^\d+\.\s+") & (n > 60) & contains_any(low, V.LIST_VERBS))
        | low.rlike("^(?:" + "|".join(V.DESCRIPTION_STARTS) + ")")
        | matches_any(low, V.INSTRUCTION_PATTERNS)
    )
    depth = numbering(t)["depth"]
    marked = (
        (F.coalesce(depth <= 3, F.lit(False)) & ((n <= 50) | ((n <= 80) & (blanks <= 8))))
        | (F.col("is_bold") & (F.col("font_size") >= 13))
        | (F.col("font_size") >= 16)
        | ((n <= 30) & (is_upper(t) | is_title(t)) & ~ends_with_any(t, ".,;"))
    )
    ws = words(low)
    function_words = F.size(F.filter(ws, lambda w: w.isin(V.FUNCTION_WORDS)))
    sound = (
        n.between(3, 100) & ~((F.size(ws) > 10) & (function_words > F.size(ws) * 0.4))
        & ~(ends_sentence(t) & (n > 20)) & ~contains_any(low, V.COMPLEX_WORDS)
    )
    return headings.where(~described & marked & sound)


def exclude_title(headings: DataFrame, titles: DataFrame, first_page: int | None = None) -> DataFrame:
    """Drop headings that repeat the title, or one line of a grouped title.

    ``first_page`` also drops headings of that page at the title's place and
    size; the published behaviour never applies this, so it is off by default.
    """
    h, t = F.lower(strip("text")), F.lower(strip("title"))

    def same(a: Column, b: Column) -> Column:
        return (a == b) | ((a != "") & (b != "") & (jaccard_words(words(a), words(b)) > 0.85))

    repeats = same(h, t) | F.coalesce(F.exists("group_lines", lambda g: same(h, F.lower(strip(g)))), F.lit(False))
    if first_page is not None:
        near = (F.abs(F.col("font_size") - F.col("title_size")) < 1) & (F.abs(F.col("y_position") - F.col("title_y")) < 20)
        repeats = repeats | F.coalesce((F.col("page") == first_page) & near, F.lit(False))
    known = F.coalesce("title", F.lit("")) != ""
    return headings.join(titles, "doc_id", "left").where(~known | ~repeats).select(*headings.columns)


# --- levels from the whole document -----------------------------------------------------

def relative_depth(headings: DataFrame) -> DataFrame:
    """Numbering depths present in a document, in order, become levels 1 to 6."""
    depth = numbering(F.col("text"))["depth"]
    by_depth = Window.partitionBy("doc_id").orderBy("depth")
    return headings.withColumn("depth", depth).where("depth is not null").withColumn(
        "level", F.least(F.dense_rank().over(by_depth), F.lit(6))
    )


def _prominence_value(size: Column, bold: Column, position: Column) -> Column:
    return size + F.when(bold, size * 0.2).otherwise(0.0) + F.when(position == "center", size * 0.1).otherwise(0.0)


def prominence_tiers(headings: DataFrame, titles: DataFrame) -> DataFrame:
    """Levels of headings without numbers, by tiers of prominence.

    Tiers are taken greedily from the top, each more than 1 below the last;
    a heading belongs to the first tier it is within 1 of, or above.
    """
    plain = headings.where(~is_numbered("text")).withColumn(
        "prominence", F.round(_prominence_value(F.col("font_size"), F.col("is_bold"), F.col("position")), 9)
    )
    near_title = (F.col("title_size") > 0) & (F.col("font_size") >= F.col("title_size") * 0.9)
    damped = F.round(F.when(near_title, F.col("prominence") * 0.8).otherwise(F.col("prominence")), 9)
    values = plain.join(titles.select("doc_id", "title_size"), "doc_id", "left").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(damped), asc=False).alias("values")
    )
    # starts from an infinite tier so that the first value always opens one
    padded = F.aggregate(
        "values", F.array(F.lit(INF)),
        lambda acc, v: F.when(v < F.element_at(acc, F.size(acc)) - 1.0, F.concat(acc, F.array(v))).otherwise(acc),
    )
    tiers = F.slice(padded, 2, 6)
    p = F.col("prominence")
    hits = F.filter(
        F.transform("tiers", lambda tier, i: F.when((F.abs(p - tier) <= 1.0) | (p > tier), i + 1)), lambda i: i.isNotNull()
    )
    return (
        plain.join(values.select("doc_id", tiers.alias("tiers")), "doc_id")
        .withColumn("level", F.coalesce(F.array_min(hits), F.lit(6)).cast("int")).drop("tiers")
    )


def adjust_levels(headings: DataFrame, level: str = "level") -> DataFrame:
    """Contextual changes in order: numbering, centre, capitals, colon."""
    t = F.col("text")
    one = F.when(t.rlike(r"^\d+\.\d+\.\d+"), F.greatest(F.col(level), count_text(t, "."))).otherwise(F.col(level))
    two = F.when((F.col("position") == "center") & (F.col("_l") > 1), F.greatest(F.lit(1), F.col("_l") - 1)).otherwise(F.col("_l"))
    three = F.when(is_upper(t) & (F.length(t) > 3), F.greatest(F.lit(1), F.least(F.col("_l"), F.lit(2)))).otherwise(F.col("_l"))
    four = F.when(t.endswith(":") & (F.col("_l") < 3), 3).otherwise(F.col("_l"))
    out = headings.withColumn("_l", one)
    for rule in (two, three, four):
        out = out.withColumn("_l", rule)
    return out.withColumn(level, F.least("_l", F.lit(6)).cast("int")).drop("_l")


# --- the outline ----------------------------------------------------------------------------

def finalize_outline(headings: DataFrame, prefer_sequential: bool = False) -> DataFrame:
    """``H{level}`` up to 6, cleaned text, page; empty texts are dropped."""
    level = F.concat(F.lit("H"), F.least("raw_level", F.lit(6)).cast("string"))
    if prefer_sequential:
        level = F.coalesce("sequential_level", level)
    return headings.select(
        "doc_id", "page", "line_no", level.alias("level"), clean_heading("text").alias("text")
    ).where("text <> ''")


def outline(lines: DataFrame, stats: DataFrame | None = None, multiline: bool = False, prefer_sequential: bool = False) -> DataFrame:
    """Titles and headings of all documents in one pass over their lines.

    Forms have no outline. Order: candidates, minus title, plus spatial
    headings, sequences, isolation, major headings, final levels.
    """
    titles = best_title(lines, multiline)
    forms = is_form_document(lines, titles).where("is_form").select("doc_id")
    kept = lines.join(forms, "doc_id", "left_anti")
    candidates = raw_level(heading_candidates(kept, stats if stats is not None else line_font_stats(kept)))
    candidates = exclude_title(candidates.select(*HEADING), titles)
    merged = sequential_groups(merge_candidates(candidates, spatial_headings(kept)))
    isolated = isolation_filter(merged, kept, spacing_percentiles(kept))
    return finalize_outline(major_headings(isolated), prefer_sequential)


def outline_shape(documents: DataFrame, shape: str = "plain") -> DataFrame:
    """Output forms of (doc_id, title, outline, error) rows.

    ``plain`` 0-based title/level/page_number, ``display`` the same 1-based,
    ``legacy`` text/level/page 1-based with empty title and error text.
    """
    shift = 0 if shape == "plain" else 1
    if shape not in ("plain", "display", "legacy"):
        raise ValueError(f"unknown shape {shape!r}")
    name, page = ("text", "page") if shape == "legacy" else ("title", "page_number")
    items = F.transform(
        "outline",
        lambda h: F.struct(h["text"].alias(name), h["level"].alias("level"), (h["page"] + shift).alias(page)),
    )
    title = F.coalesce("title", F.lit("")) if shape == "legacy" else F.col("title")
    error = F.coalesce("error", F.lit("Processing failed")) if shape == "legacy" else F.col("error")
    return documents.select(
        "doc_id", title.alias("title"), items.alias("outline"),
        F.when(~F.col("success"), error).alias("error"),
    )
