"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the hashes of all `gram`-word runs in a window of `length` words, the least is the window's fingerprint.
Equal windows have equal fingerprints, so a join of the fingerprints of documents and items misses no
shared window; each hit is then extended to the window's whole words and compared with the items'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vectide.llm.shared import kept, lower_ascii, null_safe, text_key

LENGTH = 10
GRAM = 5
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Runs of digits, letters and all that is not ASCII, A-Z in lower case; none for a null text."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(F.col(text)), OTHER), ""), F.array().cast("array<string>"))


def _windows(size: Column, length: int) -> Column:
    """0-based starts of the windows of `length`."""
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def _with_prints(rows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Adds __p<length>, the fingerprint of each window, for rows with __words."""
    rows = rows.withColumn("__n", F.size("__words")).withColumn(
        "__h", F.transform("__words", lambda w: F.xxhash64(w)))
    for length in lengths:
        k = min(gram, length)
        reach = length - k + 1
        rows = rows.withColumn("__g", F.transform(_windows(F.col("__n"), k), lambda i: F.xxhash64(
            F.lit(length), *[F.get("__h", i + j) for j in range(k)])))
        least = (lambda i: F.least(*[F.get("__g", i + j) for j in range(reach)])) if reach > 1 else (
            lambda i: F.get("__g", i))
        rows = rows.withColumn(f"__p{length}", F.transform(_windows(F.col("__n"), length), least)).drop("__g")
    return rows


def _window_words(i: Column, length: int) -> Column:
    return F.array_join(F.slice("__words", i + 1, length), " ")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(item_id, length, fp, window): the windows of each item; an item of fewer words is one window."""
    rows = kept(items.select(F.col(id_col).alias("item_id"), words(text_col).alias("__words"))
                .filter(F.size("__words") > 0), "items")
    short = F.least(F.size("__words"), F.lit(length))
    lengths = sorted(r[0] for r in rows.select(short).distinct().collect())  # at most `length` numbers
    parts = [
        _with_prints(rows.filter(short == n), [n], gram).select(
            "item_id", F.explode(F.transform(_windows(F.col("__n"), n), lambda i: F.struct(
                F.lit(n).alias("length"), F.get(f"__p{n}", i).alias("fp"), _window_words(i, n).alias("window")))).alias("w"))
        .select("item_id", "w.*") for n in lengths]
    if not parts:
        return rows.select("item_id", F.lit(0).alias("length"), F.lit(0).cast("long").alias("fp"), F.lit("").alias("window"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", length: int = LENGTH,
                  gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items (sorted ids as strings), contaminated, per row of `docs`.

    A word is hit if an occurrence of an item's window covers it. Null and empty texts have no words, and
    items without words no windows. Items without id hit words but are not listed; items that share an id
    count once. Repeated rows and rows without id are answered each for itself. Extra columns are ignored;
    an empty table of documents gives an empty result, one of items leaves all documents clean.
    """
    bench = kept(item_windows(items, item_id, item_text, length, gram), "windows")
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), words(text_col).alias("__words"))
    prints = [F.array_distinct(f"__p{n}") for n in lengths]
    scanned = kept(_with_prints(rows, lengths, gram).select(
        "doc_id", "text_key", "__n", F.concat(F.array().cast("array<bigint>"), *prints).alias("prints")), "prints")
    hits = kept(
        scanned.select("doc_id", "text_key", F.explode("prints").alias("fp"))
        .join(bench.select("fp").distinct(), "fp")
        .groupBy("doc_id", "text_key").agg(F.collect_set("fp").alias("__hits")), "hits")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("__text"))
    again = null_safe(texts, hits, ["doc_id", "text_key"]).withColumn("__words", words("__text"))
    found = []
    for n in lengths:
        cells = _with_prints(again, [n], gram).select("doc_id", "text_key", F.explode(F.transform(
            F.filter(_windows(F.col("__n"), n), lambda i: F.array_contains("__hits", F.get(f"__p{n}", i))),
            lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), _window_words(i, n).alias("window")))).alias("c"))
        found.append(cells.select("doc_id", "text_key", "c.*"))
    whole = scanned.select("doc_id", "text_key", F.col("__n").cast("long").alias("n_words"))
    if not found:
        return whole.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                            F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    cells = found[0]
    for part in found[1:]:
        cells = cells.union(part)
    true = kept(cells.join(bench.select("window").distinct(), "window"), "matches")
    start, end = "start", "end"
    spans = F.array_sort(F.collect_set(F.struct(F.col("start").alias(start), (F.col("start") + F.col("length")).alias(end))))
    state = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    covered = F.aggregate(spans, state, lambda a, x: F.struct(
        F.greatest(a["reach"], x[end]).alias("reach"),
        (a["n"] + F.greatest(F.lit(0), x[end] - F.greatest(a["reach"], x[start]))).alias("n")), lambda a: a["n"])
    hit = true.groupBy("doc_id", "text_key").agg(covered.cast("long").alias("n_hit"))
    listed = (
        true.select("doc_id", "text_key", "window").distinct()
        .join(bench.select("window", "item_id").distinct(), "window")
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    both = null_safe(hit, listed, ["doc_id", "text_key"])
    out = null_safe(whole, both, ["doc_id", "text_key"], "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
                      items_found.alias("items"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without hits, with all their columns."""
    bad = contamination(docs, items, id_col, text_col).filter("contaminated").select(
        F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__bad_id")) & (text_key(text_col) == F.col("__bad_key"))
    return docs.join(kept(bad, "contaminated").hint("shuffle_hash"), same, "left_anti")
