"""Blocks to elements: font mode, tables, reading order, classification, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def body_font(spans: DataFrame) -> DataFrame:
    """PRS-01: most frequent size (to 0.1) of spans longer than 3 characters; first seen wins a tie; 10 without any."""
    good = spans.where(F.length(F.trim("text")) > 3).select("doc_id", F.round("size", 1).alias("size"), "seq")
    per = good.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    best = per.groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("seq")).alias("s"))).alias("body"))
    return spans.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(10.0)).alias("body"))


def markdown_table(rows: Column) -> Column:
    """PRS-02: array of arrays of cells as a Markdown table; line breaks in cells become spaces."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit(":---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")


def outside_tables(blocks: DataFrame, tables: DataFrame, margin: float = 2.0) -> DataFrame:
    """PRS-03: blocks whose centre lies in no table of their page; the join is on the page."""
    t = tables.select(F.col("doc_id").alias("td"), F.col("page").alias("tp"), *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("doc_id") == F.col("td")) & (F.col("page") == F.col("tp")) & cx.between(F.col("tx0") - margin, F.col("tx1") + margin) & cy.between(F.col("ty0") - margin, F.col("ty1") + margin)
    return blocks.join(t, inside, "left_anti")


def assemble(spans: DataFrame) -> DataFrame:
    """PRS-04: spans(doc_id, page, block, line, seq, text, size, bold) to blocks."""
    lines = spans.groupBy("doc_id", "page", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("t"), F.max("size").alias("size"), F.bool_or("bold").alias("bold")
    )
    return lines.groupBy("doc_id", "page", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("text"), F.max("size").alias("size"), F.bool_or("bold").alias("bold")
    )


def reading_order(blocks: DataFrame, slack: float = 15.0) -> DataFrame:
    """PRS-05: adds `ord`. Two or more blocks on each side of the middle make two columns: wide blocks of the top third, left, right, other wide ones."""
    page = Window.partitionBy("doc_id", "page")
    mid = F.col("page_w") / 2
    left, right = F.col("x1") <= mid + slack, F.col("x0") >= mid - slack
    two = (F.count_if(left).over(page) >= 2) & (F.count_if(right & ~left).over(page) >= 2)
    zone = F.when(~two, 0).when(~left & ~right & (F.col("y0") < F.col("page_h") / 3), 0).when(left, 1).when(right, 2).otherwise(3)
    rows = blocks.withColumn("zone", zone)
    return rows.withColumn("ord", F.row_number().over(page.orderBy("zone", "y0", "x0", "block"))).drop("zone")


def merge_by_top(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """PRS-06: blocks and tables by their upper edge; blocks stand first in a tie (this undoes column order, as is)."""
    both = blocks.select("doc_id", "page", "y0", F.lit(0).alias("kind"), F.col("ord").alias("seq"), "text").unionByName(tables.select("doc_id", "page", "y0", F.lit(1).alias("kind"), F.col("seq"), "text"))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "kind", "seq")))


def classify(text: Column, size: Column, body: Column, bold: Column, page: Column) -> Column:
    """PRS-07."""
    ratio, n = size / body, F.size(F.split(F.trim(text), r"\s+"))
    item = F.trim(text).rlike(r"^(?:[-*•]|\d+[.)]|[a-z]\))\s+")
    return (
        F.when((page == 1) & (ratio >= 1.8) & (F.length(text) <= 80), "title")
        .when(item, "list")
        .when((F.length(text) > 120) | (n > 20), "paragraph")
        .when(ratio >= 1.5, "h1")
        .when(ratio >= 1.25, "h2")
        .when(ratio >= 1.15, "h3")
        .when(bold & (ratio >= 1.08) & ~F.trim(text).rlike(r"[.;:,]$"), "h3")
        .otherwise("paragraph")
    )


def breadcrumbs(elements: DataFrame) -> DataFrame:
    """PRS-08: adds section: the last h1 > h2 > h3 above each row; a heading resets the lower levels. elements(doc_id, ord, type, text)."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.last(F.when(F.col("type") == f"h{k}", F.struct(F.col("ord").alias("at"), F.col("text").alias("t"))), ignorenulls=True).over(w) for k in (1, 2, 3)]
    rows = elements.select("*", *[s.alias(f"_h{k}") for k, s in enumerate(seen, 1)])
    h1, h2, h3 = (F.col(f"_h{k}") for k in (1, 2, 3))
    live2 = h2.isNotNull() & (h1.isNull() | (h2["at"] > h1["at"]))
    live3 = h3.isNotNull() & (h1.isNull() | (h3["at"] > h1["at"])) & (h2.isNull() | (h3["at"] > h2["at"]))
    return rows.withColumn("section", F.concat_ws(" > ", h1["t"], F.when(live2, h2["t"]), F.when(live3, h3["t"]))).drop("_h1", "_h2", "_h3")


#: Tags that end a run of text; those of inline elements do not.
_BLOCK = (
    "address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hgroup|hr|html|iframe|legend|li|main|"
    "menu|nav|ol|optgroup|option|p|pre|search|section|select|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul"
)
#: Comments, and the elements whose content is no text of the page; one left open reaches to the end.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\z)"
#: A tag of a name; a ">" inside a quoted attribute does not end it. Possessive, as Java's other loops recurse.
_REST = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"


def html_elements(pages: DataFrame) -> DataFrame:
    """Elements of raw web pages: (doc_id, ord, type, text).

    Every run of text between two block tags is an element, so no visible text is lost; h1 to h6, p, li and title
    begin elements of their type, which end at their own end tag or at the next block tag. Other runs are paragraphs.
    """
    mark, stop = "\x01", "\x02"
    html = F.regexp_replace(F.translate("html", mark + stop, "  "), _HIDDEN, " ")
    # a block tag becomes a mark, its name and a stop: the text behind it is a run of that name
    html = F.regexp_replace(html, rf"(?i)<(/?)({_BLOCK}){_REST}", f"{mark}$1$2{stop}")
    html = F.regexp_replace(html, rf"(?i)</?[a-z][a-z0-9:-]*{_REST}|<[!?][^>]*+>", "")
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(html, mark)).alias("ord", "run"))
    name = F.lower(F.regexp_extract("run", rf"^([^{stop}]*+){stop}", 1))
    text = F.regexp_replace(F.regexp_replace("run", rf"^[^{stop}]*+{stop}", ""), r"^\s+|\s+$", "")
    kind = F.when(name == "li", "list").when(name.rlike("^(h[1-6]|title)$"), name).otherwise("paragraph")
    return rows.select("doc_id", "ord", kind.alias("type"), text.alias("text")).where("text <> ''")
