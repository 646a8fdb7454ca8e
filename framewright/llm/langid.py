"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds three of them: the elementwise product of the first
letter's vector permuted twice, the second's permuted once and the third's. A text bundles its trigrams, each as often
as it occurs; a language bundles all its training texts. A text gets the language of the largest cosine.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_texts, materialize, small_batches, texts_of, whole_row

#: Symbol 0 is any run of characters that aren't letters, 1 to 26 are a to z; trigrams of these are tabulated. Any other letter is a symbol of its own.
SYMBOLS = 27
#: Bits of a symbol in the code of a trigram that is not tabulated, and how many such trigrams are bound together.
BITS, BLOCK = 21, 4096
DIMENSIONS = 1024
SEED = 20240229
UNKNOWN = "und"
#: Three deviations of the cosine of unlike vectors.
NOISE = 3 / DIMENSIONS**0.5
#: Quantiles of cosines are read off a histogram of so many steps, which is the same in whatever order it is counted.
STEPS = 1000
#: Binary digits of the number of distinct trigrams.
LENGTH = "length(bin(trigrams))"


@lru_cache(1)
def symbol_table():
    """Symbol of each code point."""
    import numpy as np

    t = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()[0]
            t[c] = ord(low) - 96 if "a" <= low <= "z" else SYMBOLS + ord(low)
    return t


@lru_cache(1)
def letter_vectors():
    """The vectors of symbols below SYMBOLS."""
    import numpy as np

    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


@lru_cache(1 << 14)
def letter_vector(symbol: int):
    """The vector of any symbol; beyond the tabulated ones it is drawn from the symbol, so that no two letters share one."""
    import numpy as np

    if symbol < SYMBOLS:
        return letter_vectors()[symbol]
    return np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


@lru_cache(1)
def trigram_vectors():
    """The bound vector of each of SYMBOLS^3 trigrams, as int8."""
    import numpy as np

    letters = letter_vectors()
    two, one = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    pairs = two[:, None, :] * one[None, :, :]
    return (pairs.reshape(-1, 1, DIMENSIONS) * letters[None]).reshape(-1, DIMENSIONS)


def bundled(codes):
    """The sum of the bound vectors of trigrams that are not tabulated, as often as each occurs."""
    import numpy as np

    total = np.zeros(DIMENSIONS, np.float64)
    found, n = np.unique(codes, return_counts=True)
    for at in range(0, len(found), BLOCK):
        some = found[at : at + BLOCK]
        parts = np.stack([some >> 2 * BITS, some >> BITS & (1 << BITS) - 1, some & (1 << BITS) - 1])
        symbols, where = np.unique(parts, return_inverse=True)
        where, letters = where.reshape(parts.shape), np.stack([letter_vector(int(x)) for x in symbols])
        bound = np.roll(letters, 2, axis=1)[where[0]] * np.roll(letters, 1, axis=1)[where[1]] * letters[where[2]]
        total += n[at : at + BLOCK].astype(np.float32) @ bound.astype(np.float32)
    return total


def trigrams(texts: list[str]):
    """For each text the codes of all its trigrams, the tabulated ones and the others; both empty if it has no letter."""
    import numpy as np

    points = np.frombuffer("\n\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    s = symbol_table()[points]
    none = np.zeros(0, np.int64)
    for a, n in zip(starts, lengths):
        own = s[a : a + n]
        if not own.any():
            yield none, none
            continue
        own = np.concatenate([[0], own, [0]])
        own = own[np.concatenate([[True], (own[1:] != 0) | (own[:-1] != 0)])]
        if len(own) < 3:
            yield none, none
            continue
        if own.max() < SYMBOLS:
            yield (own[:-2] * SYMBOLS + own[1:-1]) * SYMBOLS + own[2:], none
            continue
        own = own.astype(np.int64)
        x, y, z = own[:-2], own[1:-1], own[2:]
        plain = np.maximum(np.maximum(x, y), z) < SYMBOLS
        yield ((x * SYMBOLS + y) * SYMBOLS + z)[plain], (((x << BITS) + y << BITS) + z)[~plain]


def _partial_profiles(text_col: str, lang_col: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, sums = {}, {}
        for b in small_batches(batches, text_col):
            others = {}
            for lang, (codes, more) in zip(b.column(lang_col).to_pylist(), trigrams(texts_of(b, text_col))):
                if lang not in counts:
                    counts[lang], sums[lang] = np.zeros(SYMBOLS**3, np.int64), np.zeros(DIMENSIONS)
                np.add(counts[lang], np.bincount(codes, minlength=SYMBOLS**3), out=counts[lang])
                if len(more):
                    others.setdefault(lang, []).append(more)
            for lang, found in others.items():
                sums[lang] += bundled(np.concatenate(found))
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            vec = n[used].astype(np.float64) @ trigram_vectors()[used].astype(np.float32) + sums[lang]
            yield pa.RecordBatch.from_pydict({"lang": [lang], "part": [_partition()], "vec": [vec.astype("<f8").tobytes()]})

    return run


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _sum_vectors(rows):
    import numpy as np
    import pandas as pd

    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [0], "vec": [sum(np.frombuffer(v, "<f8") for v in rows["vec"]).tobytes()]})


def learn_profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", fan_in: int = 64) -> dict:
    """{language: prototype} from all rows with a language. Each partition sums its own texts; at most fan_in sums a language reach the driver."""
    import numpy as np

    schema = "lang string, part long, vec binary"
    sums = map_texts(rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null"), _partial_profiles("text", "lang"), schema)
    sums = sums.groupBy("lang", F.pmod("part", F.lit(fan_in))).applyInPandas(_sum_vectors, schema)
    found: dict = {}
    for r in sums.collect():
        v = np.frombuffer(r["vec"], "<f8")
        found[r["lang"]] = found.get(r["lang"], 0) + v
    return {k: v for k, v in sorted(found.items()) if np.any(v)}


def identify(docs: DataFrame, profiles: dict, text_col: str = "text", pass_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """pass_cols, lang_pred, score (the cosine, 0 if negative), trigrams (how many distinct ones the text has).

    Null or empty texts, and texts without a letter, are UNKNOWN with score 0, and so is everything if no language was
    learned. Equal cosines go to the first language by code point.
    """
    langs = list(profiles)
    schema = T.StructType([*docs.select(*pass_cols).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("trigrams", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = trigram_vectors()
        if langs:
            protos = np.stack([profiles[x] / np.linalg.norm(profiles[x]) for x in langs]).astype(np.float32)
        for b in small_batches(batches, "__text"):
            pred, score, distinct = [], [], []
            for codes, more in trigrams(texts_of(b, "__text")):
                if not len(codes) + len(more) or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    distinct.append(0)
                    continue
                n = np.bincount(codes, minlength=len(table))
                used = np.flatnonzero(n)
                vec = n[used].astype(np.float32) @ table[used].astype(np.float32)
                if len(more):
                    vec = vec + bundled(more).astype(np.float32)
                cos = protos @ vec / max(float(np.linalg.norm(vec)), 1e-12)
                k = int(np.argmax(cos))
                pred.append(langs[k])
                score.append(float(min(1.0, max(0.0, cos[k]))))
                distinct.append(len(used) + len(np.unique(more)))
            own = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(distinct, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in pass_cols] + own, names=[*pass_cols, "lang_pred", "score", "trigrams"])

    return map_texts(docs.select(*pass_cols, F.col(text_col).alias("__text")), run, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, held: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score for every row; learned from the rows with crc32(id) mod `mod` other than `held` that have a language.

    A row with a null id is never held out. Null and empty texts, and those without a letter, are `und` with score 0.
    Texts are read whole; repeated rows are learned from and answered each by itself; equal cosines go to the first
    language by code point. An empty table gives an empty result; columns other than the three named play no part,
    whatever their names.
    """
    profiles = learn_profiles(docs.filter(crc_mod(id_col, mod) != held), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("_id"), (crc_mod(id_col, mod) == held).alias("held_out"), F.col(text_col).alias("_text"))
    return identify(rows, profiles, "_text", ("_id", "held_out")).drop("trigrams").withColumnRenamed("_id", id_col)


def low_cosine(bins: dict[int, int], quantile: float) -> float:
    """The lower end of the step of a histogram of cosines in which the quantile lies."""
    upto, total = 0, sum(bins.values())
    for at in sorted(bins):
        upto += bins[at]
        if upto >= quantile * total:
            break
    return at / STEPS


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", quantile: float = 0.01) -> DataFrame:
    """docs without the rows whose text is in none of the learned languages: no letters, or a cosine below that language's threshold. All columns stay.

    The threshold is half the low quantile of the cosines of a language's own labelled texts, of all of them or of those
    with about as many distinct trigrams (the same power of two), whichever is less, as the cosines of short texts
    scatter more; and NOISE at least, which is all where no such text is labelled. Null and empty texts go; rows without
    a language are judged like any other; repeated rows stay or go together. An empty table gives an empty result;
    columns other than the two named play no part, whatever their names.
    """
    profiles = learn_profiles(docs, text_col, lang_col)
    rows = docs.select(whole_row(docs).alias("_row"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_t"))
    scored = materialize(identify(rows, profiles, "_t", ("_row", "_lang")).filter(F.col("lang_pred") != UNKNOWN), "langid-scored")
    own = scored.filter("lang_pred = _lang").groupBy("lang_pred", F.expr(LENGTH).alias("length"), F.floor(F.col("score") * STEPS).alias("b")).agg(F.count("*").alias("n"))
    all_, some = {}, {}
    for r in own.collect():  # for each language STEPS + 1 rows for each power of two at most
        for per, key in ((all_, r["lang_pred"]), (some, (r["lang_pred"], r["length"]))):
            bins = per.setdefault(key, {})
            bins[r["b"]] = bins.get(r["b"], 0) + r["n"]
    rows = [(lang, length, min(low_cosine(all_[lang], quantile), low_cosine(bins, quantile)) / 2) for (lang, length), bins in sorted(some.items())]
    least = docs.sparkSession.createDataFrame(rows, "_of string, _length int, _least double")  # a row for each power of two and language, each of which the driver holds a profile of
    judged = scored.join(F.broadcast(least), (F.col("lang_pred") == F.col("_of")) & (F.expr(LENGTH) == F.col("_length")), "left")
    return judged.filter(F.col("score") >= F.greatest(F.lit(NOISE), F.coalesce("_least", F.lit(NOISE)))).select("_row.*")
