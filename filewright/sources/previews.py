"""Text previews: pages, paragraphs, tables, CSV, and the snippet of any file."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.functions import text as X
from filewright.functions.binding import let


def page_text(
    pages: DataFrame, doc: str = "doc", page_no: str = "page_no", text: str = "text",
    max_pages: int = C.PAGES_PER_DOC, *, max_chars: int,
) -> DataFrame:
    """Text of each document's first pages, up to the page that fills ``max_chars`` (a taxonomy's ``max_chars``, for snippets).

    Each task keeps a document's first pages before the shuffle (a row-number
    limit Spark pushes below it), cut to the characters that can matter. So a
    document with very many or very long pages moves next to nothing.
    """
    short = pages.select(
        F.col(doc), F.col(page_no), F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars).alias("_text"))
    by_doc = Window.partitionBy(doc).orderBy(page_no)
    first = short.withColumn("_n", F.row_number().over(by_doc)).where(F.col("_n") <= max_pages)
    before = F.sum(F.length("_text")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < max_chars)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_text")))
    return kept.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda p: p["_text"]), "\n").alias("text"))


def paragraph_text(
    paragraphs: DataFrame, doc: str = "doc", position: str = "position", text: str = "text",
    max_paragraphs: int = C.PARAGRAPHS_PER_DOC, *, max_chars: int,
) -> DataFrame:
    """Text of each document's first paragraphs, blank ones dropped after counting."""
    short = paragraphs.select(
        F.col(doc), F.col(position),
        F.substring(F.col(text), 1, max_chars).alias("_text"), X.is_blank(F.col(text)).alias("_blank"))
    by_doc = Window.partitionBy(doc).orderBy(position)
    first = short.withColumn("_n", F.row_number().over(by_doc)).where(F.col("_n") <= max_paragraphs)
    kept = F.array_sort(F.collect_list(F.when(~F.col("_blank"), F.struct("_n", "_text"))))
    return first.groupBy(doc).agg(F.array_join(F.transform(kept, lambda p: p["_text"]), "\n").alias("text"))


def format_preview(header: Column, rows: Column) -> Column:
    """Preview text from an array of column names and an array of row texts."""
    return F.concat(F.lit("Columns: "), F.array_join(header, ", "), F.lit("\nData:\n"), F.array_join(rows, "\n"))


def table_preview(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, rows: int = C.PREVIEW_ROWS) -> DataFrame:
    """Column names and first rows of a table, by a distributed top-k."""
    columns = list(columns or df.columns)
    line = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(keys))]
    first = df.select(line.alias("_line"), *keys).orderBy(*names).limit(rows)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*names, "_line"))), lambda r: r["_line"])
    return first.agg(format_preview(F.array(*[F.lit(c) for c in columns]), lines).alias("preview"))


# One field and what ends it. A field that opens with a quote goes on to the closing one, and then to the next separator.
CSV_VALUE = r'(?>"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+)?+|[^,\r\n]*+)'
CSV_FIELD = rf"({CSV_VALUE})(,|\r\n?|\n|\z)"
# So many first records, or all, with their line ends.
CSV_RECORDS = rf"^(?:(?:{CSV_VALUE},)*+{CSV_VALUE}(?:\r\n?+|\n|\z)){{0,%d}}+"
MARK = "\ufdd0"  # stands for two quotes while one is looked for; escaped where a text holds it


def _unquoted(field: Column) -> Column:
    """What a field says: without its quotes, doubled ones inside them being one."""
    marked = F.replace(F.replace(F.substring(field, 2, 1 << 30), F.lit(MARK), F.lit(MARK + "a")), F.lit('""'), F.lit(MARK + "b"))

    def plain(part: Column, quotes: str) -> Column:
        return F.replace(F.replace(part, F.lit(MARK + "b"), F.lit(quotes)), F.lit(MARK + "a"), F.lit(MARK))

    def said(inner: Column) -> Column:
        close = F.instr(inner, F.lit('"'))
        return F.when(close == 0, plain(inner, '"')).otherwise(
            F.concat(plain(F.left(inner, close - 1), '"'), plain(F.substring(inner, close + 1, F.lit(1 << 30)), '""')))

    return F.when(F.startswith(field, F.lit('"')), let(marked, said)).otherwise(field)


def csv_preview(text: Column | str, rows: int = C.PREVIEW_ROWS) -> Column:
    """Header and first rows of CSV text, with line breaks in quotes; NULL for NULL, empty for empty.

    Fields and what ends them are found by one pattern that never goes back; records are what lies between line ends. What is
    used more than once is bound, so each text is cut once whatever the number of its fields.
    """
    text = F.col(text) if isinstance(text, str) else text
    # The records to show, found from the start: what comes behind them is not split into fields.
    top = F.regexp_extract(text, CSV_RECORDS % (rows + 1), 0)

    def line(parts: Column, lines: Column, n: Column) -> Column:
        first = F.when(n == 0, F.lit(0)).otherwise(F.get(lines, n - 1) + 1)
        return F.array_join(F.transform(F.slice(parts, first + 1, F.get(lines, n) - first + 1), _unquoted), ", ")

    def shown(parts: Column, lines: Column) -> Column:
        # The pattern also finds nothing at the end of the text; it is a field only after a comma.
        count = F.size(lines) - F.when(F.coalesce(F.get(lines, F.size(lines) - 2) == F.get(lines, F.size(lines) - 1) - 1, F.lit(False)), 1).otherwise(0)
        numbers = F.slice(F.sequence(F.lit(0), F.size(lines)), 1, F.least(count, F.lit(rows + 1)))
        return let(F.transform(numbers, lambda n: line(parts, lines, n)), lambda taken: F.concat(
            F.lit("Columns: "), F.get(taken, F.lit(0)), F.lit("\nData:\n"), F.array_join(F.slice(taken, 2, max(1, rows)), "\n")))

    def cut(t: Column) -> Column:
        parts, ends = (F.regexp_extract_all(t, F.lit(CSV_FIELD), F.lit(i)) for i in (1, 2))
        # Where a line ends; the text's own end counts, unless a line end stands before it.
        last = F.filter(F.transform(ends, lambda e, i: F.when(e != ",", i)), lambda i: i.isNotNull())
        return let(parts, lambda p: let(last, lambda at: shown(p, at)))

    return F.when(text == "", F.lit("")).when(text.isNotNull(), let(top, cut))


def has_text(max_chars: int, text: str = "text") -> Column:
    """Whether the snippet of a file will not be blank, from its raw text: redaction never makes a text blank, and any
    record of a CSV text shows in its preview."""
    plain = F.col("ext").isin([*C.TEXT_EXTS, ".pdf", ".docx"]) & ~X.is_blank(F.substring(text, 1, max_chars))
    return F.coalesce(plain | ((F.col("ext") == ".csv") & (F.length(text) > 0)), F.lit(False))


def with_snippet(
    files: DataFrame, max_chars: int = C.SNIPPET_CHARS, text: str = "text", csv_files: bool = True,
    order: str = "default", redact_first: bool = False,
) -> DataFrame:
    """Add ``snippet`` by extension; '' for what has no reader or no text.

    Paged and word-processor files carry their extracted text in the text
    column (see ``page_text`` and ``paragraph_text``). Of a CSV text twice as many characters as the snippet has are
    looked at, which any preview of that length is made from; ``csv_files=False`` leaves them out.
    """
    plain = F.col("ext").isin([*C.TEXT_EXTS, ".pdf", ".docx"])
    raw = F.when(plain, F.col(text))
    if csv_files:
        raw = raw.when(F.col("ext") == ".csv", csv_preview(F.substring(text, 1, 2 * max_chars)))
    return files.withColumn("snippet", X.snippet(raw, max_chars, order, redact_first))
