"""Structure-aware chunking of marked-up pages into passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions.text import let, strip

#: What marks a page and a heading, and the name of what comes before the first (fixed values).
PAGE = r"(?iU)^\s*<!--\s*page\s*:\s*(\d+)\s*-->\s*$"
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*$"
START = "文档开头"
#: What ends a line: all that Unicode counts as line ends, and the separators of files, groups and records.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def split_long(text: Column, size: int, overlap: int) -> Column:
    """Pieces of at most `size` characters, cut after the last line or sentence end in a window's second half, each overlapping the next.

    A fold over as many steps as the text can have pieces; the state is where the next piece starts. Each step moves on
    by half a window less the overlap at least, or by one character. What a step uses more than once is bound, as an
    expression inside a fold is computed anew wherever it stands.
    """
    steps = F.ceil(F.length(text) / F.lit(max(1, size // 2 + 1 - overlap))).cast("int") + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def fold(n: Column) -> Column:
        def cut(s: Column, window: Column, length: Column) -> Column:
            piece = F.filter(F.array(strip(F.substring(window, F.lit(1), length))), lambda p: p != "")
            following = F.when(s["at"] + size >= n, n).otherwise(F.greatest(s["at"] + length - overlap, s["at"] + 1))
            return F.struct(following.alias("at"), F.concat(s["pieces"], piece).alias("pieces"))

        def ends(window: Column) -> Column:
            """How much of the window is behind its last end of a line or sentence, that included."""
            return let(F.reverse(window), lambda back: F.length(window) + 1 - F.least(*(F.nullif(F.instr(back, c), F.lit(0)) for c in "\n。；")))

        def step(s: Column, _: Column) -> Column:
            length = lambda w: let(ends(w), lambda e: F.when((s["at"] + size >= n) | e.isNull() | (e - 1 <= size // 2), F.length(w)).otherwise(e))
            moved = let(F.substring(text, s["at"] + 1, F.lit(size)), lambda w: let(length(w), lambda k: cut(s, w, k)))
            return F.when(s["at"] >= n, s).otherwise(moved)

        return F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda s: s["pieces"])

    return F.when(F.length(text) <= size, F.array(text)).otherwise(let(F.length(text), fold))


def chunk(documents: DataFrame, max_chars: int = 900, overlap_chars: int = 120, min_chars: int = 40) -> DataFrame:
    """(chunk_id, document_id, company, year, section, page, text) of documents (document_id, company, year, markdown).

    Page markers and headings end a passage; a heading holds across pages. Pieces below min_chars go, then the rest
    are numbered. One shuffle by document: windows, grouping and numbering reuse it.
    """
    if max_chars <= 0 or not 0 <= overlap_chars < max_chars:
        raise ValueError("max_chars must be positive and overlap_chars in [0, max_chars)")
    lines = documents.select("document_id", "company", "year", F.posexplode(F.split("markdown", LINE_END)).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    order = W.partitionBy("document_id", "company", "year").orderBy("pos")
    page = F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")).cast("int")
    heading = F.nullif(F.regexp_extract("line", HEADING, 2), F.lit(""))
    marked = lines.withColumns({"mark": page, "heading": F.when(page.isNull(), heading)})
    bound = F.col("mark").isNotNull() | F.col("heading").isNotNull()
    marked = marked.withColumns(
        {
            "segment": F.sum(bound.cast("int")).over(order),
            "page": F.last("mark", ignorenulls=True).over(order),
            "section": F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit(START)),
            "bound": bound,
        }
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("bound"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    keys = ["document_id", "company", "year", "segment"]
    segments = marked.groupBy(*keys).agg(F.first("page").alias("page"), F.first("section").alias("section"), strip(body).alias("text")).where("text <> ''")
    pieces = segments.select(*keys, "page", "section", F.posexplode(split_long(F.col("text"), max_chars, overlap_chars)).alias("piece", "text")).where(F.length("text") >= min_chars)
    number = F.row_number().over(W.partitionBy("document_id", "company", "year").orderBy("segment", "piece")) - 1
    padded = F.when(number > 9999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 4, "0"))
    return pieces.select(F.concat_ws(":", "document_id", padded).alias("chunk_id"), "document_id", "company", "year", "section", "page", "text")
