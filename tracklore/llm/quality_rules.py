"""Quality rules on words and lines, and cross-document line frequency; built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm.common import Scratch, cut, sized_join

BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A line is boilerplate in a host if more than LINE_SHARE of the host's distinct texts have it and FEW_DOCS at least, so small
#: hosts have boilerplate too, or if MANY_DOCS of them have it, whatever their share.
LINE_SHARE, FEW_DOCS, MANY_DOCS = 0.10, 3, 10_000
#: A document fails with fewer words, and is depleted if what is left without such lines is, or is under this share of its words.
LEAST_WORDS, DEPLETED = 50, 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Windows are keys of hash bits over their place; sorted, windows of equal hash are neighbours, and the places of those
    whose words equal a neighbour's give the words covered.
    """

    def covered(w: Column, bits: Column) -> Column:
        def key(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

        def places(s: Column, mask: Column) -> Column:
            def same(x: Column, other: Column) -> Column:
                i, j = (y.bitwiseAND(F.bitwise_not(mask)).cast("int") for y in (x, other))
                equal = [F.get(w, i + k) == F.get(w, j + k) for k in range(3)]
                return (x.bitwiseXOR(other).bitwiseAND(mask) == 0) & equal[0] & equal[1] & equal[2]

            twice = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), same(x, F.coalesce(F.get(s, j - 1), F.get(s, j + 1))), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.bitwise_not(mask))))

        mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))
        sums = F.aggregate(
            let(keys, lambda s: let(mask, lambda m: places(s, m))),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
        )
        return F.when(F.size(w) >= 3, sums["n"]).otherwise(F.lit(0).cast("long"))

    return let(words, lambda w: let(F.length(F.bin(F.size(w).cast("long"))), lambda bits: covered(w, bits)))


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, with digits alike and white space as single spaces."""
    return F.xxhash64(F.trim(F.translate(F.regexp_replace(F.lower(line), BREAK, " "), "123456789", "000000000")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def boilerplate(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, text_key, boilerplate_words, lines) of each distinct text of docs (host, text_key, text) that has lines above
    the limits in its host, with the hashes of those lines.

    Texts are read once, to hashes and word counts of their lines; a text that a host has many times counts once.
    """
    line = lambda x: F.struct(line_key(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))
    own = docs.select("host", "text_key", F.transform(_lines(F.col("text")), line).alias("lines"))
    own = scratch.table(own.groupBy("host", "text_key").agg(F.first("lines").alias("lines")))
    totals = scratch.table(own.groupBy("host").agg(F.count("*").alias("texts")))
    found = own.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= FEW_DOCS)
    found = sized_join(found, totals, ["host"], 48).where((F.col("n") > LINE_SHARE * F.col("texts")) | (F.col("n") >= MANY_DOCS)).select("host", "line")
    lines = own.select("host", "text_key", F.explode("lines").alias("x")).select("host", "text_key", "x.line", "x.n")
    gone = sized_join(lines, scratch.table(found), ["host", "line"], 56)
    return scratch.table(gone.groupBy("host", "text_key").agg(F.sum("n").alias("boilerplate_words"), F.collect_set("line").alias("lines")))


def _measured(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, measures, verdict, less and row of each row of docs: less is its text without boilerplate lines, row all its other columns."""
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    docs = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as scratch:
        gone = cut(boilerplate(docs, scratch))
    text = F.col("text")
    base = docs.select("row", "doc_id", "host", "text_key", text, words_of(text).alias("words")).select(
        "row",
        "doc_id",
        "host",
        "text_key",
        text,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    base = base.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = sized_join(base, gone, ["host", "text_key"], 8 * F.size("lines") + 64, "left")
    out = out.withColumn("boilerplate_words", F.coalesce("boilerplate_words", F.lit(0)).cast("long"))
    # one comparison of both sides: as two, the first would be pushed below the join and measure each text twice
    out = out.withColumn("kept", F.col("boilerplate_words") <= F.when(F.col("base_failed"), -1.0).otherwise(F.least(DEPLETED * F.col("n_words"), F.col("n_words") - float(LEAST_WORDS))))
    rest = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains("lines", line_key(line)))
    return out.withColumn("less", F.when(F.col("lines").isNull(), text).otherwise(F.array_join(rest, "\n")))


def quality_rules(docs: DataFrame, host: str = "source", whole: bool = False) -> DataFrame:
    """Measures and verdict of each row of docs (doc_id, text, host column), and its text without boilerplate lines if whole.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are the base measures; base_failed rejects texts of
    under 50 words and those with more than half of their words in repeated windows. boilerplate_words counts the words
    in lines that the host repeats across documents, which are removed; kept is false also where less than half of the
    words are left, or under 50. Distinct texts are counted, so groups of copies do not make their own lines boilerplate; the limits
    of a line act alike in hosts of every size. Null and empty texts have
    no words and fail. A null host is the same host as an empty one; a null doc_id stays null; rows that repeat get equal
    results. Other columns are ignored. An empty table gives no rows.
    """
    out = _measured(docs.select("doc_id", "text", host), host)
    less = [F.col("less").alias("text")] if whole else []
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words", *less)


def cleaned(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; text is without the lines that are boilerplate.

    Null and empty texts have no words and go; a null host is the same host as an empty one; null ids and extra columns
    stay; rows that repeat have one verdict. An empty table gives no rows.
    """
    return _measured(docs, host).where("kept").select(*[F.col("less").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
