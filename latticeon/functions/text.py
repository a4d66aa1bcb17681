"""Ranked text search: tokens, BM25 and the multi-field positional search.

Corpus statistics are one aggregate row, joined back by a broadcast of that row;
scores are plain column arithmetic over token arrays.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of at least three bytes."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: F.octet_length(x) >= 3)


def _is(q: str):
    return lambda x: x == q


def _bucket_if(words: Column):
    """Buckets of eight places for the words among `words`."""
    return lambda w, j: F.when(F.array_contains(words, w), F.floor(j / 8))


def query_terms(q: str) -> list[str]:
    return list(dict.fromkeys(w for w in _WORD.findall(q.lower()) if len(w.encode()) >= 3))


def with_bm25(df: DataFrame, field: str, query: str, name: str) -> DataFrame:
    """df with the score of each row's field as column name; 0 where nothing matches or the field is null.

    The corpus is df: apply it before filters.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn(name, F.lit(0.0))
    n = [f"__{name}_{i}" for i in range(len(terms))]
    toks = tokens(F.col(field))
    # One pass over the tokens: [length, tf of each term].
    counts = F.transform(F.array(toks), lambda t: F.array(F.size(t), *[F.size(F.filter(t, _is(q))) for q in terms]))[0]
    counted = df.withColumn(f"__{name}", F.when(F.col(field).isNotNull(), counts))
    c = F.col(f"__{name}")
    stats = df.filter(F.col(field).isNotNull()).select(counts.alias("c")).agg(F.count("*").alias(f"__{name}_n"), F.avg(F.get("c", F.lit(0))).alias(f"__{name}_avg"), *[F.sum((F.get("c", F.lit(i + 1)) > 0).cast("long")).alias(x) for i, x in enumerate(n)])
    both = counted.crossJoin(F.broadcast(stats))  # one row
    total, avg = F.col(f"__{name}_n"), F.col(f"__{name}_avg")

    def part(i: int) -> Column:
        df_, tf = F.coalesce(F.col(n[i]), F.lit(0)), F.get(c, F.lit(i + 1))
        idf = F.greatest(F.lit(0.0), F.ln((total - df_ + 0.5) / (df_ + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.get(c, F.lit(0)) / avg))

    score = reduce(lambda a, b: a + b, [F.when(F.get(c, F.lit(i + 1)) > 0, part(i)).otherwise(0.0) for i in range(len(terms))])
    return both.withColumn(name, F.coalesce(score, F.lit(0.0))).drop(f"__{name}", f"__{name}_n", f"__{name}_avg", *n)


def allowed_edits(term: str) -> int:
    n = len(term.encode())
    return 0 if n <= 4 else 1 if n <= 8 else 2


def with_search(df: DataFrame, fields: list[str], query: str, name: str, key: str = "_id") -> DataFrame:
    """df with name (matches all terms) and name_score (banded cascade, null where it doesn't match).

    A term that no row has exactly stands for the vocabulary's words within its edit distance:
    the expansion is a small table of one row, found by an aggregate over distinct words.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn(name, F.lit(False)).withColumn(name + "_score", F.lit(None).cast("double"))
    arrays = [F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")) for f in fields]
    t = df.withColumn("__t", F.array(*arrays))

    def near(w: Column, q: str) -> Column:
        """The length first: few words of a vocabulary are left for the distance."""
        k = allowed_edits(q)
        return F.length(w).between(len(q) - k, len(q) + k) & (F.levenshtein(w, F.lit(q), k) >= 0)

    # Only words near a term leave their task; what is aggregated is a few spellings of the terms.
    words = t.select(F.explode(F.flatten("__t")).alias("w")).filter(reduce(lambda a, b: a | b, [near(F.col("w"), q) for q in terms])).distinct()
    per = []
    for i, q in enumerate(terms):
        some = F.collect_set(F.when(near(F.col("w"), q), F.struct(F.col("w").alias("w"), F.levenshtein(F.col("w"), F.lit(q)).alias("e"))))
        per.append(F.when(F.max(F.col("w") == q), F.array(F.struct(F.lit(q).alias("w"), F.lit(0).alias("e")))).otherwise(some).alias(f"__x{i}"))
    both = t.crossJoin(F.broadcast(words.agg(*per)))  # one row, of spellings within two edits
    flat = F.flatten("__t")
    # Per term: the fewest edits of a matching word, and the buckets where matching words stand.
    for i in range(len(terms)):
        x = F.col(f"__x{i}")
        words = F.transform(x, lambda s: s["w"])
        both = both.withColumn(f"__e{i}", F.array_min(F.transform(F.filter(x, lambda s: F.array_contains(flat, s["w"])), lambda s: s["e"])))
        both = both.withColumn(f"__b{i}", F.array_compact(F.transform(flat, _bucket_if(words))))
    hit = reduce(lambda a, b: a & b, [F.col(f"__e{i}").isNotNull() for i in range(len(terms))])
    m = float(len(terms))
    typo = F.lit(1.0) - reduce(lambda a, b: a + b, [F.col(f"__e{i}") for i in range(len(terms))]) / (2 * m)

    def close(i: int) -> Column:
        return F.lit(1.0) / (1 + least_gap(F.col(f"__b{i}"), F.col(f"__b{i + 1}")))

    proximity = F.lit(1.0) if len(terms) == 1 else reduce(lambda a, b: a + b, [close(i) for i in range(len(terms) - 1)]) / (m - 1)
    any_word = F.flatten(F.array(*[F.transform(F.col(f"__x{i}"), lambda s: s["w"]) for i in range(len(terms))]))
    best = F.array_position(F.transform("__t", lambda a: F.arrays_overlap(a, any_word)), F.lit(True)) - 1
    order = F.lit(1.0) if len(fields) == 1 else F.lit(1.0) - best / float(len(fields) - 1)
    sizes = F.filter(F.transform("__t", lambda a: F.size(a)), lambda s: s > 0)
    least = F.array_min(sizes)
    exactness = F.when(F.array_contains(sizes, len(terms)), 1.0).when(least < len(terms), F.lit(0.0)).otherwise(m / least)
    score = F.lit(1e12) + typo * 1e9 + proximity * 1e6 + order * 1e3 + exactness
    drop = ["__t", *[f"__{p}{i}" for p in "xeb" for i in range(len(terms))]]
    return both.withColumn(name, hit).withColumn(name + "_score", F.when(hit, score)).drop(*drop)


def least_gap(a: Column, b: Column) -> Column:
    """The least distance of a number of a from one of b: among neighbours of both in order, so no pairs are made."""
    mark = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("p"), F.lit(k).alias("k")))

    def gaps(s: Column) -> Column:
        step = lambda x, i: F.when(F.get(s, i + 1)["k"] != x["k"], F.get(s, i + 1)["p"] - x["p"])
        return F.array_min(F.transform(s, step))

    return F.transform(F.array(F.sort_array(F.concat(mark(a, 0), mark(b, 1)))), gaps)[0]


# ── trigrams ──
def trigrams(c: Column) -> Column:
    """Distinct runs of three characters, lower-cased; of the array of characters, as places in a long text are dear."""
    run = lambda x, i, all: F.concat(x, F.get(all, i + 1), F.get(all, i + 2))
    of = lambda all: F.array_distinct(F.array_compact(F.transform(all, lambda x, i: run(x, i, all))))
    return F.transform(F.array(F.split(F.lower(c), "")), of)[0]


def pattern_trigrams(pattern: str) -> list[str]:
    """Those that every match of an ILIKE pattern has: of its parts between %."""
    return sorted({p[i : i + 3] for p in pattern.strip().lower().split("%") for i in range(len(p) - 2)})


def trigram_index(df: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """Postings (trigram, key). Save it partitioned or bucketed by trigram where it is asked more than once."""
    return df.filter(F.col(field).isNotNull()).select(F.explode(trigrams(F.col(field))).alias("trigram"), key)


def index_candidates(index: DataFrame, pattern: str, key: str = "_id") -> DataFrame | None:
    """Keys whose postings have all the pattern's trigrams; None where it has none and every row is a candidate."""
    want = pattern_trigrams(pattern)
    if not want:
        return None
    hits = index.filter(F.col("trigram").isin(want)).groupBy(key).agg(F.count_distinct("trigram").alias("n"))
    return hits.filter(F.col("n") == len(want)).select(key)


def verify_ilike(df: DataFrame, field: str, pattern: str, candidates: DataFrame | None, key: str = "_id") -> DataFrame:
    rows = df if candidates is None else df.join(candidates, key, "left_semi")
    return trigram_candidates(rows, field, pattern)


def trigram_candidates(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """ILIKE search: rows whose field has the pattern's parts, in any case."""
    from .predicates import like

    return df.filter(like(F.col(field), pattern, ignore_case=True))
