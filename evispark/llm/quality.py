"""Quality rules: word and line counts, and cross-document line frequency by host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import SPACES, let, prefix_of, quoted, saved, with_text, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate on a host if more distinct texts hold it than both: so many, and the square root of the host's texts.
LINE_DOCS = 20
#: A document is depleted if fewer than this percentage of its words remain.
KEPT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Lists up to this long are scanned.
SHORT_LIST = 32
#: Hosts' line lists of up to so many lines in all are broadcast (8 bytes each); beyond, lines are joined by shuffle, dealt to SALTS parts each.
BROADCAST_LINES, SALTS = 1_000_000, 16


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(found: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Windows are hashed and packed with their position into a long: the high bits of the hash, and as many low bits as
    positions need. Sorted, equal windows are neighbours. What has an equal neighbour is then compared word by word, so
    that hashes that meet by chance don't count.
    """

    def packed(w, bits):
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(at, lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("long"))))

    def alike(s, test):
        """The items of the sorted array s that test() finds alike to a neighbour."""
        return F.filter(s, lambda x, i: ((i > 0) & test(F.get(s, i - 1), x)) | test(x, F.get(s, i + 1)))

    def flagged(w, bits):
        same = lambda x, y: F.coalesce(F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits), F.lit(False))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return let(packed(w, bits), lambda s: F.transform(alike(s, same), lambda x: x.bitwiseAND(mask).cast("int")))

    def exact(w, at):
        windows = F.sort_array(F.transform(at, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        return let(windows, lambda s: F.transform(alike(s, same), lambda x: x["i"]))

    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    bits = F.length(F.bin(F.size(found)))
    at = let(bits, lambda b: flagged(found, b))
    return F.when(F.size(found) < 4, 0).otherwise(let(at, lambda x: F.when(F.size(x) == 0, 0).otherwise(covered(exact(found, x)))))


def base(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))

    def whole(c):
        return F.struct(
            c["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup_lines(text).cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            ((c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)).alias("base_failed"),
        )

    return let(counts, whole)


def line_hash(line: Column) -> Column:
    """Of the line in lower case, trimmed, digits as 0; null for a line without a word."""
    plain = F.trim(F.translate(F.lower(line), SPACES[1:] + "123456789", " " * 5 + "0" * 9))
    return F.when(plain != "", F.xxhash64(plain))


def line_hashes(text: Column) -> Column:
    return F.array_compact(F.array_distinct(F.transform(F.split(text, "\n"), line_hash)))


def frequent_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """(host, line), written: the hashes of the lines that too many distinct texts of a host (a null one too) hold.

    Equal texts of a host count once, as copies say nothing on how common a line is. The limit is line_docs texts, or
    the square root of the host's where that is more: on a host of 100,000 texts 316, of a million 1,000. So a host's
    list is at most as long as that root times its texts' mean number of lines. Each (host, line, text) is combined before
    the shuffle, so a line that all documents share is spread over tasks.
    """
    text = F.coalesce("text", F.lit(""))
    one = F.concat(F.array(F.lit(None).cast("long")), line_hashes(text))  # null stands for the text itself
    rows = docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("text_hash"), F.explode(one).alias("line"))
    counts = saved(rows.distinct().groupBy("host", "line").count().where((F.col("count") > line_docs) | F.col("line").isNull()), "lines")
    totals = counts.where("line is null").select(F.col("host").alias("of"), F.col("count").alias("texts"))
    over = counts.where("line is not null").join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("count") * F.col("count") > F.col("texts"))
    return saved(over.select("host", "line"), "frequent")


def holds(sorted_lines: Column, line: Column) -> Column:
    """Whether a sorted array of longs holds a value (not null): by a scan if it is short, else by binary search, whose steps each evaluate the value."""
    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_lines).alias("hi"))

    def halve(at, _):
        mid = F.call_function("shiftright", at["lo"] + at["hi"], F.lit(1))
        right = F.get(sorted_lines, mid) < line
        half = F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(mid).alias("hi"))
        return F.when(at["lo"] < at["hi"], half).otherwise(at)

    found = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(sorted_lines)))), start, halve, lambda at: at["lo"])
    short = F.size(sorted_lines) <= SHORT_LIST
    return F.coalesce(F.when(short, F.array_contains(sorted_lines, line)).otherwise(F.get(sorted_lines, found) == line), F.lit(False))


def listed(docs: DataFrame, frequent: DataFrame, host: str, small: bool, column: str) -> DataFrame:
    """docs with a column of sorted hashes that has the frequent lines of its text, and maybe others of its host: null or empty if none.

    Hosts' lists are broadcast if they are `small`. Else the lines of texts are joined with them, both dealt out by a
    salt as well, so that neither a host's list nor a hot line's texts meet in one task; then texts take up their lines.
    """
    if small:
        lists = frequent.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias(column)).withColumnRenamed("host", f"{column}_host")
        return docs.join(F.broadcast(lists), F.col(host).eqNullSafe(F.col(f"{column}_host")), "left").drop(f"{column}_host")
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.col(host), F.col(host).isNull(), text)
    lines = docs.select(F.col(host).alias("of"), key.alias("text_key"), F.explode(line_hashes(text)).alias("has")).distinct()
    dealt = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = lines.withColumn("own", F.pmod("text_key", F.lit(SALTS))).join(dealt, (F.col("has") == F.col("line")) & (F.col("own") == F.col("salt")) & F.col("of").eqNullSafe(F.col("host")))
    lists = met.groupBy("text_key").agg(F.sort_array(F.collect_set("line")).alias(column)).withColumnRenamed("text_key", f"{column}_key")
    return docs.withColumn(f"{column}_own", key).join(lists, F.col(f"{column}_own") == F.col(f"{column}_key"), "left").drop(f"{column}_own", f"{column}_key")


def judged(docs: DataFrame, host: str = "source", kept_percent: int = KEPT_PERCENT, broadcast_lines: int = BROADCAST_LINES, prefix: str = "__", **limits) -> DataFrame:
    """The rows of docs with __base (see base), __left (words in lines that stay), __kept and __text (the lines that stay).

    A document is kept if its base rules hold and at least kept_percent of its words are in lines below the limits of
    frequent_lines. Repeated rows are judged alike; a null text fails by its word count; texts of any length are read
    whole; no documents give no rows. Other columns stay as they are; `prefix` names the new ones where docs has such names.
    """
    own = prefix_of(docs)
    frequent = frequent_lines(docs, host, **limits)
    small = frequent.count() <= broadcast_lines
    text = F.coalesce("text", F.lit(""))
    joined = listed(docs, frequent, host, small, f"{own}lines")
    lines = F.col(f"{own}lines")
    stays = lambda x: let(line_hash(x), lambda h: ~holds(lines, h))
    # without a list, or where no line is on it, the text stays as it is
    cut = F.when(lines.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    # a filter on __kept is not pushed below a row number, as it would compute the cut a second time there
    joined = joined.withColumns({f"{own}row": F.monotonically_increasing_id(), f"{own}cut": let(F.struct(base(text).alias("base"), cut.alias("text")), lambda x: F.struct(
        x["base"].alias("base"), x["text"].alias("text"),
        F.when(F.length(x["text"]) == F.length(text), x["base"]["n_words"]).otherwise(F.size(words(x["text"])).cast("long")).alias("left"),
    ))})
    found = F.col(f"{own}cut")
    kept = ~found["base"]["base_failed"] & (found["left"] * 100 >= found["base"]["n_words"] * kept_percent) & (F.col(f"{own}row") >= 0)
    return joined.select(*map(quoted, docs.columns), found["base"].alias(f"{prefix}base"), found["left"].alias(f"{prefix}left"), kept.alias(f"{prefix}kept"), found["text"].alias(f"{prefix}text"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The documents that judged() keeps, their frequent lines removed; n_chars, if there is such a column, follows the text."""
    own = prefix_of(docs)
    return with_text(judged(docs, prefix=own, **options).where(f"{own}kept"), docs, F.col(f"{own}text"))


_W = r"[\x20\x09-\x0D]"
#: The same rows in SQL.
QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
tri AS (SELECT r, i, list_slice(w, i, i + 2) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
filled AS (SELECT * FROM lines WHERE regexp_replace(line, '{_W}', '', 'g') <> ''),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY r),
norm AS (SELECT r, host, text, line, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '{_W}', ' ', 'g'), ' ') AS plain FROM filled),
seen AS (SELECT host, plain, count(DISTINCT text) AS n FROM norm GROUP BY host, plain),
texts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
often AS (SELECT s.host, s.plain FROM seen s JOIN texts t ON s.host IS NOT DISTINCT FROM t.host WHERE s.n > {LINE_DOCS} AND s.n * s.n > t.n),
lost AS (SELECT n.r, sum(len(regexp_extract_all(n.line, '[^\\x20\\x09-\\x0D]+'))) AS n FROM norm n JOIN often o ON n.host IS NOT DISTINCT FROM o.host AND n.plain = o.plain GROUP BY n.r),
base AS (
  SELECT d.r, d.doc_id, len(w.w) AS n_words, len(regexp_replace(d.text, '{_W}', '', 'g')) AS word_chars,
         len(d.text) - len(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d JOIN w ON w.r = d.r LEFT JOIN dups u ON u.r = d.r LEFT JOIN rep p ON p.r = d.r),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed AND (f.n_words - coalesce(l.n, 0)) * 100 >= f.n_words * {KEPT_PERCENT} AS kept
FROM failed f LEFT JOIN lost l ON l.r = f.r
"""
