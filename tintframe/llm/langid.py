"""Language ID with hyperdimensional profiles (operator 8).

Each letter has a fixed random vector of +1 and -1. A trigram's vector binds (multiplies) those of its letters, permuted
(rotated) by place; a text's vector bundles (adds) its trigrams', and so does a language's prototype with those of all its
texts. A text gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices

DIMENSIONS = 1024
SEED = 8
#: Letter classes: 0 is a word's edge; U+0041 to U+024F have their own, other letters share the rest by hash.
CLASSES = 640
CHARS_AT_ONCE = 1 << 19
#: Trigrams whose vectors are held at once.
GRAMS_AT_ONCE = 16_384
#: Added to each text's length in a slice, so that a slice holds few texts.
PER_TEXT = 2000
UNKNOWN = "und"


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, dimensions))


def letter_table() -> np.ndarray:
    """The class of each code point: letters by their lower case, all else is an edge."""
    table = np.zeros(0x110000, dtype=np.int16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 0x40 if low < 0x250 else 528 + (low * 2654435761 >> 7) % (CLASSES - 528)
    return table


_TABLE: list[np.ndarray] = []


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, trigram) of every trigram, with an edge at both ends; runs of other characters are one edge."""
    if not _TABLE:
        _TABLE.append(letter_table())
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _TABLE[0][points].astype(np.int64)
    size = np.array([len(t) + 1 for t in texts])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), size)])
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:]
    inside = (code[1:-1] != 0) | ((code[:-2] != 0) & (code[2:] != 0))  # the middle is a letter, or an edge between letters
    same = (owner[1:-1] == owner[2:]) & inside
    return owner[1:-1][same], gram[same]


def long_trigrams(text: str):
    """The trigrams of one text, as ``trigrams`` has them, in runs of ``CHARS_AT_ONCE`` at most: two bytes a character are held."""
    if not _TABLE:
        _TABLE.append(letter_table())
    pieces, before = [np.zeros(1, dtype=np.int16)], 0
    for at in range(0, len(text), CHARS_AT_ONCE):
        points = np.frombuffer(text[at : at + CHARS_AT_ONCE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = _TABLE[0][points]
        keep = code != 0
        keep[1:] |= code[:-1] != 0
        keep[0] |= before != 0
        before = int(code[-1])
        pieces.append(code[keep])
    pieces.append(np.zeros(int(before != 0), dtype=np.int16))
    code = np.concatenate(pieces)
    for at in range(0, len(code) - 2, CHARS_AT_ONCE):
        part = code[at : at + CHARS_AT_ONCE + 2].astype(np.int64)
        inside = (part[1:-1] != 0) | ((part[:-2] != 0) & (part[2:] != 0))
        yield ((part[:-2] * CLASSES + part[1:-1]) * CLASSES + part[2:])[inside]


def numbered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams, ascending, and each trigram's place among them; without sorting where few letters occur."""
    parts = gram // (CLASSES * CLASSES), gram // CLASSES % CLASSES, gram % CLASSES
    seen = np.zeros(CLASSES, dtype=bool)
    for p in parts:
        seen[p] = True
    used = np.flatnonzero(seen)
    k = len(used)
    if k > 160:
        return np.unique(gram, return_inverse=True)
    short = np.cumsum(seen) - 1
    dense = (short[parts[0]] * k + short[parts[1]]) * k + short[parts[2]]
    present = np.zeros(k**3, dtype=bool)
    present[dense] = True
    found = np.flatnonzero(present)
    place = np.cumsum(present) - 1
    return (used[found // (k * k)] * CLASSES + used[found // k % k]) * CLASSES + used[found % k], place[dense]


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    a, b, c = grams // (CLASSES * CLASSES), grams // CLASSES % CLASSES, grams % CLASSES
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def train_prototypes(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED):
    """(languages, one prototype a row), from all rows with a text and a language.

    Trigram counts by language are summed in Spark; each task then bundles its share of the counted trigrams. What comes to the
    driver is one vector for each language. Counts are damped by a square root, so that no common word outweighs the rest.
    """

    def count(batches):
        import pandas as pd

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for i, j in slices(texts, lambda t: len(t) + 1, CHARS_AT_ONCE):
                    long = j - i == 1 and len(texts[i]) > CHARS_AT_ONCE
                    for gram in long_trigrams(texts[i]) if long else (trigrams(texts[i:j])[1],):
                        if len(gram):
                            grams, place = numbered(gram)
                            yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(place)})

    def bundle(batches):
        import pandas as pd

        letters, sums = letter_vectors(dimensions, seed), {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for at in range(0, len(part), GRAMS_AT_ONCE):
                    block = part.iloc[at : at + GRAMS_AT_ONCE]
                    weight = np.sqrt(block["n"].to_numpy(dtype=np.float64))
                    sums[lang] = sums.get(lang, 0) + weight @ gram_vectors(block["gram"].to_numpy(), letters).astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]})

    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.mapInPandas(bundle, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    found = sorted(whole.collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), dimensions)


def with_language(
    df: DataFrame,
    languages: list[str],
    prototypes: np.ndarray,
    text_col: str = "text",
    seed: int = SEED,
    out_cols: tuple[str, ...] = ("lang_pred", "score"),
) -> DataFrame:
    """``df`` with lang_pred and score (the cosine, from 0 to 1) in ``out_cols``, and in a third of them, if given, whether the text has a letter;
    columns of the first two names are replaced.

    ``und`` with score 0 for a null text, one without letters, or where no language was learned; equal cosines go to the
    language first in alphabetical order. Whole texts count; other columns are not looked at, and rows are independent.
    """
    dimensions = prototypes.shape[1]
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(length > 0, length, 1)).astype(np.float32)
    names = np.array([*languages, UNKNOWN], dtype=object)

    @F.pandas_udf("lang_pred string, score double, lettered boolean")
    def predict(texts):
        import pandas as pd

        letters = letter_vectors(dimensions, seed)
        texts = ["" if t is None else t for t in texts]
        pred, score, lettered = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, j in slices(texts, lambda t: len(t) + PER_TEXT, CHARS_AT_ONCE):
            vectors, some = text_vectors(texts[i:j], letters)
            lettered[i:j] = some
            if not len(unit):
                continue
            norm = np.linalg.norm(vectors, axis=1)
            cos = vectors @ unit.T / np.maximum(norm, 1e-30)[:, None]
            pred[i:j] = np.where(some, cos.argmax(axis=1), -1)
            score[i:j] = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0)
        return pd.DataFrame({"lang_pred": names[pred], "score": score, "lettered": lettered})

    df = df.drop(*out_cols[:2])
    name = free_name(df, "language")
    found = df.withColumn(name, predict(F.col(text_col).cast("string")))
    return found.withColumns({c: F.col(name)[f] for c, f in zip(out_cols, ("lang_pred", "score", "lettered"))}).drop(name)


def text_vectors(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text, and whether it has any trigram; memory is bounded by ``GRAMS_AT_ONCE`` vectors beside the counts."""
    long = len(texts) == 1 and len(texts[0]) > CHARS_AT_ONCE
    vectors, some = np.zeros((len(texts), letters.shape[1]), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    if long:
        grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for gram in long_trigrams(texts[0]):
            more, place = np.unique(np.concatenate([grams, gram]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n, np.ones(len(gram), np.int64)])).astype(np.int64)
            grams = more
        owner, place = np.zeros(len(grams), np.int64), np.arange(len(grams))
    else:
        owner, gram = trigrams(texts)
        if not len(gram):
            return vectors, some
        grams, place = numbered(gram)
        n = None
        if len(grams) > GRAMS_AT_ONCE:
            order = np.argsort(place, kind="stable")
            owner, place = owner[order], place[order]
    some[owner] = True
    for at in range(0, len(grams), GRAMS_AT_ONCE):
        block = grams[at : at + GRAMS_AT_ONCE]
        i, j = (0, len(place)) if len(grams) <= GRAMS_AT_ONCE else np.searchsorted(place, [at, at + GRAMS_AT_ONCE])
        cell = owner[i:j] * len(block) + place[i:j] - at
        counts = np.bincount(cell, None if n is None else n[i:j], minlength=len(texts) * len(block)).reshape(len(texts), -1)
        vectors += np.sqrt(counts, dtype=np.float32) @ gram_vectors(block, letters).astype(np.float32)
    return vectors, some


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, out_cols: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with lang_pred and score, learned from its own rows that are not held out."""
    languages, prototypes = train_prototypes(df.filter(~held_out()))
    return with_language(df, languages, prototypes, out_cols=out_cols)


def in_a_language(df: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text is in a language, with their own columns only: null texts and those without a letter go. Where no
    language could be learned, every text with a letter stays."""
    names = tuple(free_name(df, c) for c in ("__lang_pred", "__score", "__lettered"))
    return identify(df, names).filter(F.col(names[2])).select(*df.columns)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
