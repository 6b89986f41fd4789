"""Language identification: text likelihoods fused with declared language, address suffix and smoothed host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.common import cut, empty_safe, sized_join

#: Cells of a language's hashed trigram profile; labelled rows of each language that it is learnt from, about, at most.
CELLS, PROFILE_ROWS = 1 << 14, 2_000
#: A value of lang is a language if one labelled row in so many has it: so the model has this many languages at most.
LANGUAGE_SHARE = 1_000
#: Weight of the text's log likelihood per trigram-ending byte, as neighbouring trigrams share evidence.
TEMPER = 0.25
#: Pseudo-counts that a host borrows from its suffix, a suffix from all rows, and each declared value or suffix from none.
HOST, SUFFIX, FLAT = 8.0, 32.0, 1.0
#: Least fused probability of the language of an accepted text: the usual threshold of language filters for web text.
CERTAIN = 0.65


def _cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cell of the trigram that ends at each byte of its text, letters in lower case; -1 where it holds no letter."""
    low = data.astype(np.uint32)
    low[(data >= 65) & (data <= 90)] += 32
    low = np.where((low >= 128) | (low >= 97) & (low <= 122), low, np.uint32(32))
    starts = offsets[:-1][np.diff(offsets) > 0]
    before = [low]
    for _ in range(2):  # the byte before, a space where a text begins
        last = np.concatenate((np.full(1, 32, np.uint32), before[-1][:-1]))[: len(low)]
        last[starts] = 32
        before.append(last)
    gram = before[0] | before[1] << np.uint32(8) | before[2] << np.uint32(16)
    cell = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)
    cell[(before[0] == 32) & (before[1] == 32) & (before[2] == 32)] = -1
    return cell


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): the cells of each batch's texts by language."""
    for batch in empty_safe(batches):
        langs = batch.column("lang").dictionary_encode()
        of, names = langs.indices.to_numpy(), langs.dictionary
        total = np.zeros((len(names), CELLS), np.int64)
        for a, _, data, offsets in tk.slices(batch.column("text")):
            cell = _cells(data, offsets)
            text = np.searchsorted(offsets, np.arange(len(data)), "right") - 1
            good = cell >= 0
            np.add.at(total, (of[a + text[good]], cell[good]), 1)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": names.take(pa.array(lang)), "cell": pa.array(cell, pa.int32()), "n": pa.array(total[lang, cell])})


def _profile(key: tuple, group: pa.Table) -> pa.Table:
    total = np.zeros(CELLS)
    total[group["cell"].to_numpy()] = group["n"].to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()])})


def profiles(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each cell by language) from rows (lang, text); null languages are left out, and
    values of fewer rows than LANGUAGE_SHARE asks for.

    Texts are picked by their hash, so that a language has about PROFILE_ROWS different ones, whatever the order of rows
    is; equal texts count once. Each batch's cells are summed by language and cell, so a task holds CELLS counts of a
    language and the driver as many of each of at most LANGUAGE_SHARE.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.lower("lang").alias("lang"), "text", F.xxhash64("text").alias("key"))
    sizes = cut(rows.groupBy("lang", "key").agg(F.count("*").alias("copies")).groupBy("lang").agg(F.count("*").alias("texts"), F.sum("copies").alias("rows")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    sizes = sizes.where(F.col("rows") * LANGUAGE_SHARE >= total).select("lang", "texts")
    spot = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(sizes), "lang").where(spot * F.col("texts") < PROFILE_ROWS)
    picked = picked.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")
    cells = picked.mapInArrow(_counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = cells.groupBy("lang").applyInArrow(_profile, "lang string, counts binary").collect()
    counts = {r["lang"]: np.frombuffer(r["counts"]) for r in found}
    names = sorted(counts)
    table = np.stack([counts[x] for x in names]) + 0.5 if names else np.zeros((0, CELLS))
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if names else table


def _likelihoods(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in empty_safe(batches):
            out = []
            for _, _, data, offsets in tk.slices(batch.column("text")):
                cell = _cells(data, offsets)
                good = cell >= 0
                n = np.concatenate(([0], np.cumsum(good)))
                rows = [n[offsets[1:]] - n[offsets[:-1]]]
                for own in table:
                    total = np.concatenate(([0], np.cumsum(np.where(good, own[np.maximum(cell, 0)], 0), dtype=np.float64)))
                    rows.append(total[offsets[1:]] - total[offsets[:-1]])
                out.append(np.stack(rows, 1))
            flat = np.concatenate(out)
            n, best = flat[:, 0], flat[:, 1:]
            shape = pa.FixedSizeListArray.from_arrays(pa.array(best.ravel()), best.shape[1]).cast(pa.list_(pa.float64()))
            rows = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(rows | {"n_grams": pa.array(n.astype(np.int64)), "loglik": shape})

    return run


def _softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """Sums of the text posteriors by key, as an array."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(k)]).alias("sums"))


def _with_likelihoods(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows with <key>_loglik: log p(value of key | language) for each language, from sums grouped by value; '' tells nothing."""
    sums = cut(_sums(rows.where(F.col(key) != ""), k, key))
    total = sums.agg(F.count("*"), *[F.sum(F.col("sums")[i]) for i in range(k)]).first()
    of = [(x or 0.0) + FLAT * (total[0] + 1) for x in total[1:]]
    table = sums.select(key, F.array(*[F.log((F.col("sums")[i] + FLAT) / of[i]) for i in range(k)]).alias(f"{key}_loglik"))
    none = F.array(*[F.lit(0.0)] * k)
    return sized_join(rows, table, [key], 8 * k + 32, "left").withColumn(f"{key}_loglik", F.coalesce(f"{key}_loglik", none))


def language_id(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, lang, probability, text_lang, accepted) of each row of rows (id, text, declared, host, suffix).

    labelled (lang, text) gives the trigram profiles. Text likelihoods by language give text posteriors, and their sums,
    grouped over all rows, give how likely each declared language and suffix is in each language, and the share of each
    language in a host, smoothed by its suffix's, which is smoothed by that of all. A row's own posterior is taken out
    of its host's sum. All four are fused by Bayes' rule, for any number of languages and values. accepted is false for a text without letters, for one that no
    language explains better than equally likely trigrams would, for one whose fused language is less probable than
    CERTAIN, and for one whose text alone speaks for another language than the fused one. Null and empty texts have no likelihood, so the other
    evidence decides their lang; null declared, host or suffix is no evidence; a null id stays null; rows that repeat
    get equal results; with no profiles lang is null. Other columns are ignored. An empty table gives no rows.
    """
    spark = rows.sparkSession
    names, table = profiles(labelled)
    plain = rows.select("id", "text", *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("declared", "host", "suffix")])
    if not names:
        none = F.lit(None)
        return plain.select("id", none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("text_lang"), F.lit(False).alias("accepted"))
    k = len(names)
    model = spark.sparkContext.broadcast(table)
    kind = next(t for c, t in plain.dtypes if c == "id")
    seen = plain.mapInArrow(_likelihoods(model), f"id {kind}, declared string, host string, suffix string, n_grams long, loglik array<double>")
    seen = seen.withColumn("evidence", F.transform("loglik", lambda x: x * TEMPER)).withColumn("post", _softmax(F.col("evidence")))
    seen = cut(seen.drop("evidence"))
    every = np.array((_sums(seen, k).first() or [None])[0] or [1.0] * k, float)
    every = (every + 1) / (every + 1).sum()
    suffixes = _sums(seen, k, "suffix")
    share = [((F.col("suffix_sums")[i] + SUFFIX * float(every[i])) / (F.aggregate("suffix_sums", F.lit(0.0), lambda a, b: a + b) + SUFFIX)) for i in range(k)]
    hosts = sized_join(_sums(seen, k, "host", "suffix"), cut(suffixes.select("suffix", F.col("sums").alias("suffix_sums"))), ["suffix"], 8 * k + 32)
    hosts = cut(hosts.select("host", "suffix", F.col("sums").alias("host_sums"), F.array(*share).alias("parent")))
    joined = sized_join(seen, hosts, ["host", "suffix"], 16 * k + 64)
    joined = _with_likelihoods(_with_likelihoods(joined, "declared", k), "suffix", k)
    others = F.zip_with("host_sums", "post", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = F.zip_with(others, "parent", lambda a, b: F.log(a + HOST * b))
    parts = [F.transform("loglik", lambda x: x * TEMPER), prior, F.col("declared_loglik"), F.col("suffix_loglik")]
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    fused = joined.withColumn("fused", total).withColumn("posterior", _softmax(F.col("fused")))
    tongue = F.array(*map(F.lit, names))

    def best(scores: str) -> Column:
        return F.get(tongue, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    explained = F.array_max("loglik") > F.col("n_grams") * float(-np.log(CELLS))
    agreed = (F.array_max("posterior") >= CERTAIN) & (best("posterior") == best("loglik"))
    return fused.select("id", best("posterior").alias("lang"), F.array_max("posterior").alias("probability"), F.when(F.col("n_grams") > 0, best("loglik")).alias("text_lang"), ((F.col("n_grams") > 0) & explained & agreed).alias("accepted"))


def page_fields(pages: DataFrame) -> DataFrame:
    """(id, text, declared, host, suffix) of raw pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"&#?\w{1,31};", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/:?#]+)", 1))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), F.regexp_extract(html, r"(?i)<html\b[^>]*\blang=[\"']?([A-Za-z]{2,3})", 1).alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def document_fields(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, text, lang, source): the source is the host, and its suffix what follows its last dot."""
    host = F.coalesce("source", F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), host.alias("host"), F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"))
