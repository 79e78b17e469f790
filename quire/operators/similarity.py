"""Exact word-set similarity joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import jaccard
from quire.operators.pages import saved

LIMBS = 8  # of a signature: enough to tell most sets of a hundred words apart


def prefix_length(n: Column, t: float) -> Column:
    """Sets of similarity >= t share one of the first n - ceil(t*n) + 1 words of any fixed word order."""
    return (n - F.ceil(n * t - 1e-9) + 1).cast("int")


def index_prefix_length(n: Column, t: float) -> Column:
    """The same for the shorter set of a pair, which shares at least 2t / (1 + t) of its own words."""
    return (n - F.ceil(n * (2 * t / (1 + t)) - 1e-9) + 1).cast("int")


def _ranked(sets: DataFrame, freq: DataFrame, keys: list[str]) -> DataFrame:
    """keys, no, words and signature: the words of each set from the rarest on; a table, as both sides of a join read it."""
    ranked = (
        sets.select(*keys, "no", F.explode("words").alias("_w"))
        .join(freq, [*keys, "_w"])
        .groupBy(*keys, "no")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "_w"))).alias("_r"))
        .select(*keys, "no", F.transform("_r", lambda r: r["_w"]).alias("words"))
    )
    return saved(ranked.select("*", *_signature("words")), "ranked-sets")


def _signature(words: str) -> list[Column]:
    """LIMBS whole numbers of 64 bits; each word sets one bit of one of them."""
    bits = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * LIMBS)).cast("int"))
    none = F.lit(0).cast("long")

    def limb(k: int) -> Column:
        own = F.filter(bits, lambda b: F.floor(b / 64) == k)
        return F.aggregate(own, none, lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)))

    return [limb(k).alias(f"s{k}") for k in range(LIMBS)]


def _postings(ranked: DataFrame, keys: list[str], side: str, prefix: Column) -> DataFrame:
    """keys, _w and the side's no, n, at, s0...: a row of numbers for each word of a set's prefix; sets stay behind."""
    marks = ["no", "n", *(f"s{k}" for k in range(LIMBS))]
    sized = ranked.withColumns({"n": F.size("words"), "p": F.slice("words", F.lit(1), prefix)})
    placed = sized.select(*keys, *marks, F.posexplode("p").alias("at", "_w"))
    return placed.select(*keys, "_w", *(F.col(c).alias(f"{side}_{c}") for c in [*marks, "at"]))


def _meet(longer: DataFrame, shorter: DataFrame, keys: list[str], t: float, ties: Column) -> DataFrame:
    """Candidates (p_no, i_no) of a longer set, probing, and a shorter one, indexed; of equal length where ties.

    A common word at places p and i leaves room for so many more; a bit that only one signature has is a word that only
    that set has. Both bound the common words of a pair, which must reach t / (1 + t) of the words of both sets.
    """
    size = F.size("words")
    p = _postings(longer, keys, "p", prefix_length(size, t))
    i = _postings(shorter, keys, "i", index_prefix_length(size, t))
    n_p, n_i = F.col("p_n"), F.col("i_n")
    needed = F.ceil((n_p + n_i) * (t / (1 + t)) - 1e-9)
    fits = (n_i >= n_p * t) & ((n_p > n_i) | ((n_p == n_i) & ties))
    room = F.least(n_p - F.col("p_at"), n_i - F.col("i_at")) >= needed

    def alone(a: str, b: str) -> Column:
        return sum((F.bit_count(F.col(f"{a}_s{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}_s{k}")))) for k in range(LIMBS)), F.lit(0))

    shared = F.least(n_p - alone("p", "i"), n_i - alone("i", "p")) >= needed
    return p.join(i, [*keys, "_w"]).filter(fits & room & shared).select(*keys, "p_no", "i_no").distinct()


def _confirmed(met: DataFrame, probing: DataFrame, indexed: DataFrame, keys: list[str], t: float) -> DataFrame:
    """keys, p_id, i_id, similarity of the candidates that reach t on their words."""
    p = probing.select(F.col("no").alias("p_no"), F.col("id").alias("p_id"), F.col("words").alias("p_words"))
    i = indexed.select(F.col("no").alias("i_no"), F.col("id").alias("i_id"), F.col("words").alias("i_words"))
    return (
        met.join(p, "p_no").join(i, "i_no")
        .withColumn("similarity", jaccard(F.col("p_words"), F.col("i_words")))
        .filter(F.col("similarity") >= t)
        .select(*keys, "p_id", "i_id", "similarity")
    )


def similar_pairs(a: DataFrame, b: DataFrame | None, keys: Sequence[str], t: float) -> DataFrame:
    """All (a_id, b_id) within ``keys`` whose word sets have Jaccard similarity >= t.

    ``a`` holds keys, a_id, a_words and ``b`` keys, b_id, b_words. With None for ``b``, ``a`` meets itself, and each pair
    of different ids comes once, a_id < b_id. Pairs are the result: where very many sets share most of their words, their
    number is quadratic. The longer set of a pair probes with its prefix words, the shorter is indexed under fewer of
    them, rarest first, so a word that very many short sets share indexes none of them. Sets are numbered and written to
    the shared folder; what is shuffled for each prefix word is a few numbers, and words travel for the candidates only.
    """
    keys = list(keys)

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        sets = rows.select(*keys, F.col(f"{side}_id").alias("id"), F.col(f"{side}_words").alias("words"))
        return saved(sets.withColumn("no", F.monotonically_increasing_id()), "word-sets")

    left = numbered(a, "a")
    words = left.select(*keys, F.explode("words").alias("_w"))
    if b is None:
        sets = _ranked(left, words.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n")), keys)
        met = _meet(sets, sets, keys, t, F.col("p_no") < F.col("i_no"))
        found = _confirmed(met, left, left, keys, t)
        return found.select(*keys, F.least("p_id", "i_id").alias("a_id"), F.greatest("p_id", "i_id").alias("b_id"), "similarity")
    right = numbered(b, "b")
    words = words.unionByName(right.select(*keys, F.explode("words").alias("_w")))
    freq = words.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n"))
    ranked = _ranked(left, freq, keys), _ranked(right, freq, keys)
    first = _confirmed(_meet(*ranked, keys, t, F.lit(True)), left, right, keys, t)
    second = _confirmed(_meet(*ranked[::-1], keys, t, F.lit(False)), right, left, keys, t)
    first = first.withColumnsRenamed({"p_id": "a_id", "i_id": "b_id"})
    second = second.withColumnsRenamed({"p_id": "b_id", "i_id": "a_id"})
    return first.unionByName(second).select(*keys, "a_id", "b_id", "similarity")
