"""Secret scans with character Markov models (operator 3), in DataFrame functions only.

Three patterns give base spans. Two first-order Markov models over characters - one of random strings, one of ordinary
identifiers, both trained from labelled samples - add spans: tokens whose mean log-likelihood ratio exceeds a margin.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

# The patterns of the base spans and the least lengths of what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
STATES = len(ALPHABET) + 1  # state 0: the start, or any other character
#: A token of the models: any whole run of 16 characters or more of the alphabet; the margin alone decides.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}+"
#: Documents, on average, whose words are samples of identifiers; a hash of the row picks them.
SAMPLE_DOCS = 1000
MARGIN = 0.75
BLOCK_CHARS = 4096
KINDS = ("assign", "access", "hex", "markov")


def labelled_samples(df: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random): labelled samples from a bounded sample of rows, picked by a hash of id, text and place in the table, so that
    rows without ids or with repeated ones are drawn like all others.

    Random ones are digests of that hash in hexadecimal, base 64 and capital letters with digits. Ordinary ones are the words of the
    texts, alone and joined in pairs as identifiers are: snake_case, camelCase, dotted, as paths and as CONSTANT_CASE; and
    rules and fillers, which repeat a character or two.
    """
    n = df.count()
    key = F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col), F.monotonically_increasing_id())
    drawn = df.select(key.alias("key"), F.col(text_col).cast("string").alias("text")).filter(F.pmod("key", F.lit(max(n, 1))) < sample_docs)
    # written, or the filters that Spark infers from the generators make the samples of all rows
    drawn = written(drawn, "sample")
    digest = F.sha2(F.col("key").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    random = F.array(F.substring(digest, 1, 40), F.substring(raw, 1, 40), F.upper(F.regexp_replace(raw, "[+/=]", "")))
    words = F.filter(
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 2
    )
    pairs = F.transform(
        F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: p["b"].isNotNull()),
        lambda p, i: F.concat(
            p["a"],
            F.element_at(F.array(F.lit("_"), F.lit("."), F.lit("/"), F.lit(""), F.lit("-")), i % 5 + 1),
            F.when(i % 5 == 3, F.initcap(p["b"])).otherwise(p["b"]),
        ),
    )
    constants = F.transform(F.filter(pairs, lambda p: p.contains("_")), F.upper)
    rules = F.array(*(F.lit(c * 20) for c in ALPHABET), *(F.lit((a + b) * 10) for a in "=-_.+/" for b in "=-_.+/" if a != b))
    both = drawn.select(
        random.alias("r"), F.concat(words, pairs, constants, rules).alias("w")
    )
    return both.select(F.explode("r").alias("token"), F.lit(True).alias("random")).unionByName(
        both.select(F.explode("w").alias("token"), F.lit(False).alias("random"))
    )


def train(samples: DataFrame, smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratios of all transitions, random over ordinary, as a flat STATES x STATES table.

    ``samples``: token, random. The counts are made in Spark; at most 2 x STATES x STATES of them come to the driver. Classes
    without samples give zero ratios.
    """
    at = _states(F.col("token"))
    steps = samples.filter("token is not null and random is not null").select("random", at.alias("at"))
    steps = steps.select(
        "random",
        F.explode(F.transform("at", lambda j, k: F.when(k > 0, F.get(F.col("at"), k - 1)).otherwise(0) * STATES + j)).alias("step"),
    )
    counts = np.zeros((2, STATES, STATES))
    for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect():
        counts[int(r["random"])].flat[r["step"]] = r["n"]
    if not counts.any(axis=(1, 2)).all():
        warnings.warn("a class has no labelled samples: the models find nothing", stacklevel=2)
        return np.zeros(STATES * STATES)
    p = (counts + smooth) / (counts + smooth).sum(axis=2, keepdims=True)
    return np.log(p[1] / p[0]).ravel()


def _states(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) * (c != "").cast("int"))


def log_ratio(token: Column, table: np.ndarray) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    ratios = F.lit(np.asarray(table, dtype=np.float64))
    sums = F.aggregate(
        _states(token),
        F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(j.alias("i"), (acc["sum"] + F.element_at(ratios, acc["i"] * STATES + j + 1)).alias("sum")),
    )
    return sums["sum"] / F.length(token)


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once: a lambda would evaluate an outer expression at each of its steps."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(items: Column, plus) -> Column:
    """For each of an array of INTs (a lambda's variable) what ``plus`` makes of 0 and those before it. In two levels, runs of about the
    square root of their number, since appending to an array copies it."""
    run = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), run), lambda k: F.slice(items, k, run))

    def upto(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(values, first, step)["all"]

    whole = lambda rs: upto(F.transform(rs, lambda r: F.aggregate(r, F.lit(0), plus)), F.lit(0))
    return F.flatten(_let(runs, lambda rs: F.zip_with(rs, whole(rs), upto)))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` takes: positions add up from the pieces between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))

    def placed(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: F.length(p["hit"]) + F.length(p["gap"]))
        starts = _let(sizes, lambda ns: _before(ns, lambda a, x: a + x))
        spans = F.zip_with(
            ps,
            starts,
            lambda p, at: F.when(
                keep(p["hit"]),
                F.struct(
                    (at + F.length(p["gap"])).alias("start"),
                    F.lit(KINDS.index(kind)).alias("rank"),
                    (at + F.length(p["gap"]) + F.length(p["hit"])).alias("stop"),
                ),
            ),
        )
        return F.array_compact(spans)

    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(none)


def find_secrets(df: DataFrame, text_col: str, table: np.ndarray, margin: float = MARGIN, names: tuple[str, str] = ("base_spans", "markov_spans")) -> DataFrame:
    """``df`` with base_spans and markov_spans (under ``names``), arrays of (start, rank, stop) in code points, each by start.

    rank is the place in KINDS. A null or empty text has no spans. Tokens of the models may overlap base spans
    and are whole. Columns of these names are replaced; rows are independent of each other.
    """
    df = df.drop(*names)
    own = free_name(df, "__text")
    df = df.withColumn(own, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col(own)
    base = F.concat(
        _spans(text, ASSIGN, "assign", lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_VALUE),
        _spans(text, ACCESS, "access", lambda h: F.length(h) >= ACCESS_LENGTH),
        # runs of 16 or more, directly: shorter runs are whole matches that would be dropped
        _spans(text, f"{HEX[:-1]}{{{HEX_LENGTH},}}", "hex", lambda h: F.length(h) >= HEX_LENGTH),
    )
    tokens = _spans(text, TOKEN, "markov", lambda h: log_ratio(h, table) > margin)
    return df.withColumns({names[0]: F.array_sort(base), names[1]: tokens}).drop(own)


def redact(df: DataFrame, text_col: str, table: np.ndarray, mark: str = "[secret]", margin: float = MARGIN) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``, overlapping spans by one; other rows and columns stay.

    Texts are put together from blocks of ``BLOCK_CHARS`` characters, so that cutting a piece does not read its text from the start.
    """
    base, tokens = names = (free_name(df, "base_spans"), free_name(df, "markov_spans"))
    found = find_secrets(df, text_col, table, margin, names)
    text = F.col(text_col)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))

    def cut(parts: Column, begin: Column, end: Column) -> Column:
        at = lambda x: F.floor(x / BLOCK_CHARS).cast("int")

        def within(k: Column) -> Column:
            first = F.greatest(begin, k * BLOCK_CHARS)
            return F.substring(F.get(parts, k), first - k * BLOCK_CHARS + 1, end - first)

        return F.when(end > begin, F.array_join(F.transform(F.sequence(at(begin), at(end - 1)), within), "")).otherwise("")

    def marked(spans: Column) -> Column:
        """Between marks stands what lies from the end of all spans so far to the next one that begins there or later."""
        covered = _let(F.transform(spans, lambda s: s["stop"]), lambda stops: _before(stops, lambda a, x: F.greatest(a, x)))
        fresh = F.filter(F.arrays_zip(covered.alias("begin"), F.transform(spans, lambda s: s["start"]).alias("end")), lambda p: p["end"] >= p["begin"])
        last = F.struct(F.array_max(F.transform(spans, lambda s: s["stop"])).alias("begin"), F.length(text).alias("end"))
        return _let(blocks, lambda bs: F.array_join(F.transform(F.concat(fresh, F.array(last)), lambda p: cut(bs, p["begin"], p["end"])), mark))

    clean = F.when(F.size(base) + F.size(tokens) > 0, _let(F.array_sort(F.concat(base, tokens)), marked))
    return found.withColumn(text_col, F.coalesce(clean, text)).select(*df.columns)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))),
    )


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    return train(labelled_samples(df, id_col, text_col))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, "text", trained(docs))
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(shown(F.col("base_spans")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base_spans", "markov_spans"))).alias("spans"),
    )
