"""BPE encoding and decoding by speculation and verification (operator 9).

Greedy longest match proposes the tokens of each distinct word; a word's tokens are its BPE encoding exactly if each token
encodes to itself and each adjacent pair encodes to that pair, because the first merge that crosses a boundary would
also cross it in the pair alone. All pairs are tested at once against known verdicts; only failing words are merged exactly.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Spans, mix, slices
from .tokens import byte_alphabet

#: Words, and bytes of words, that a task remembers; verdicts on pairs of tokens likewise.
WORD_CACHE, CACHE_BYTES, VERDICTS = 300_000, 32 << 20, 2_000_000
LONG_WORD = 256
CHARS_AT_ONCE = 1 << 20
NEVER = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """A ``tokenizers`` BPE file with word ends: NFC, lower case, split words, byte-level symbols and merges."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path))
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("not a BPE file with word ends")
        self.end = model["end_of_word_suffix"]
        from tokenizers import Tokenizer

        self.library, self.beyond_latin, self.byte_of = Tokenizer.from_file(path), re.compile("[^\x00-\u024f]").search, byte_alphabet()
        self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split
        vocab = model["vocab"]
        byte_of = self.byte_of
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.known: dict[tuple[bytes, bool], int] = {}
        self.symbols: dict[int, list[int]] = {}
        inner = {byte_of[t]: i for t, i in vocab.items() if len(t) == 1}
        final = {byte_of[t[0]]: i for t, i in vocab.items() if len(t) == 1 + len(self.end) and t.endswith(self.end)}
        self.inner, self.final = [inner[b] for b in range(256)], [final[b] for b in range(256)]
        for t, i in vocab.items():
            self.strings[i] = t
            last = t.endswith(self.end)
            raw = bytes(byte_of[c] for c in (t[: -len(self.end)] if last else t))
            self.known[raw, last] = i
            self.symbols[i] = self.start(raw, last)
        for t, i in self.special.items():
            self.strings[i] = t
        merges = np.array([((vocab[a] << 20) | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])], dtype=np.int64)
        self.pair_keys, self.pair_rank, self.pair_new = merges[np.argsort(merges[:, 0])].T.copy()
        self.pair_seen = np.zeros(1 << 22, dtype=bool)
        self.pair_seen[self._pair_slot(self.pair_keys)] = True
        # start symbols by token; one more token is empty
        self.empty = len(self.strings)
        self.sizes = np.array([len(self.symbols.get(i, [])) for i in range(self.empty + 1)])
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([x for i in range(self.empty) for x in self.symbols.get(i, [])])
        self._table()
        self.verdicts: dict[int, bool] = {}
        self.cached_bytes = 0
        self.words: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.shown: list[str] = []
        self.exact_words = 0
        self.ranks: dict[int, tuple[int, int]] | None = None

    def start(self, raw: bytes, last: bool) -> list[int]:
        out = [self.inner[b] for b in raw]
        if last and raw:
            out[-1] = self.final[raw[-1]]
        return out

    def _table(self) -> None:
        keys = list(self.known)
        raw = np.frombuffer(b"".join(k[0] for k in keys), dtype=np.uint8)
        size = np.array([len(k[0]) for k in keys])
        ends = np.cumsum(size)
        hashes = self._marked(Spans(raw).of(ends - size, ends), np.array([k[1] for k in keys]))
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array([self.known[keys[i]] for i in order])
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[hashes >> U64(42)] = True
        self.lengths = sorted(set(size.tolist()), reverse=True)

    @staticmethod
    def _marked(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix(hashes + last.astype(U64) * U64(0x632BE59BD9B4E019))

    def _pair_rows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NEVER where the pair doesn't merge."""
        keys = (a << 20) | b
        rank, new = np.full(len(keys), NEVER), np.zeros(len(keys), dtype=np.int64)
        hit = np.flatnonzero(self.pair_seen[self._pair_slot(keys)])
        at = np.minimum(np.searchsorted(self.pair_keys, keys[hit]), len(self.pair_keys) - 1)
        same = self.pair_keys[at] == keys[hit]
        rank[hit[same]], new[hit[same]] = self.pair_rank[at[same]], self.pair_new[at[same]]
        return rank, new

    @staticmethod
    def _pair_slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(42)

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exact merges of many words at once: (word index, symbol), in order.

        ``symbols`` holds the words one after another. In each round every word merges its pair of least rank,
        the leftmost of equals; only the pairs next to a merge are looked up again.
        """
        sym, word = symbols.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, new = np.full(len(sym), NEVER), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], new[inner] = self._pair_rows(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            going = np.repeat(least < NEVER, size)
            if not going.all():
                done.append((word[~going], sym[~going]))
                sym, word, rank, new = sym[going], word[going], rank[going], new[going]
                least, size = least[least < NEVER], size[least < NEVER]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            sym[at] = new[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            for i in (at, at[at > 0] - 1):
                rank[i] = NEVER
                i = i[i + 1 < len(sym)]
                i = i[word[i] == word[i + 1]]
                rank[i], new[i] = self._pair_rows(sym[i], sym[i + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return word[order], sym[order]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The exact merges of one long word: a heap of pairs by rank and place over a linked list of symbols."""
        n = len(symbols)
        sym, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        array = np.array(symbols, dtype=np.int64)
        rank, new = self._pair_rows(array[:-1], array[1:])
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), new.tolist(), strict=True)) if r < NEVER]
        heapq.heapify(heap)

        def push(i, j):
            pair = self._one_pair(sym[i], sym[j])
            if pair:
                heapq.heappush(heap, (pair[0], i, sym[i], sym[j], pair[1]))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue  # one of the two is gone
            sym[i], sym[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in sym if s >= 0]

    def _one_pair(self, a: int, b: int) -> tuple[int, int] | None:
        if self.ranks is None:
            self.ranks = dict(zip(self.pair_keys.tolist(), zip(self.pair_rank.tolist(), self.pair_new.tolist())))
        return self.ranks.get((a << 20) | b)

    def _gather(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The start symbols of each token, one after another, and their number."""
        size = self.sizes[tokens]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.begin[tokens] - begin, size) + np.arange(size.sum())], size

    def speculate(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, token) of the greedy longest matches of all words, in order within each word."""
        spans, at = Spans(raw), begins.copy()
        active, words, tokens = np.flatnonzero(begins < ends), [], []
        while len(active):
            token = np.full(len(active), -1)
            room = ends[active] - at[active]
            for length in self.lengths:
                open_ = np.flatnonzero((token < 0) & (room >= length))
                if not len(open_):
                    continue
                s = at[active[open_]]
                h = self._marked(spans.of(s, s + length), room[open_] == length)
                hit = np.flatnonzero(self.seen[h >> U64(42)])
                place = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                same = self.hashes[place] == h[hit]
                token[open_[hit[same]]] = self.hash_ids[place[same]]
            words.append(active)
            tokens.append(token)
            at[active] += self.sizes[token]
            active = active[at[active] < ends[active]]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def greedy(self, raw: bytes) -> list[int]:
        """The same proposal for one long word."""
        out, at = [], 0
        while at < len(raw):
            for length in self.lengths:
                stop = at + length
                if stop <= len(raw) and (t := self.known.get((raw[at:stop], stop == len(raw)))) is not None:
                    break
            out.append(t)
            at = stop
        return out

    def agreed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a before b stays so (b = -1: whether a encodes to itself); pairs not met before are merged, once."""
        if len(self.verdicts) > VERDICTS:
            self.verdicts = {}
        pairs, where = np.unique((a << 20) | (b + 1), return_inverse=True)
        unknown = np.array([p for p in pairs.tolist() if p not in self.verdicts], dtype=np.int64)
        if len(unknown):
            left, right = unknown >> 20, (unknown & 0xFFFFF) - 1
            both = np.stack([left, np.where(right < 0, self.empty, right)], axis=1)
            symbols, size = self._gather(both.ravel())
            word, merged = self.merge_many(symbols, size.reshape(-1, 2).sum(axis=1))
            count = np.bincount(word, minlength=len(unknown))
            first = np.cumsum(count) - count
            fine = (count == np.where(right < 0, 1, 2)) & (merged[first] == left)
            fine &= (right < 0) | (merged[np.minimum(first + 1, len(merged) - 1)] == right)
            self.verdicts.update(zip(unknown.tolist(), fine.tolist(), strict=True))
        return np.array([self.verdicts[p] for p in pairs.tolist()], dtype=bool)[where] if len(pairs) else np.zeros(0, bool)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, none of them empty, and n+1 offsets."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) if len(r) <= LONG_WORD else 0 for r in raws], dtype=np.int64)
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(r for r in raws if len(r) <= LONG_WORD), dtype=np.uint8)
        word, token = self.speculate(raw, ends - size, ends)
        long = [(i, self.greedy(raws[i])) for i in np.flatnonzero(size == 0)]
        word = np.concatenate([word, *(np.full(len(p), i) for i, p in long)])
        token = np.concatenate([token, *(np.array(p, dtype=np.int64) for _, p in long)])
        order = np.argsort(word, kind="stable")
        word, token = word[order], token[order]
        fails = np.zeros(len(words), dtype=bool)
        inside = word[1:] == word[:-1]
        fails[word[1:][inside][~self.agreed(token[:-1][inside], token[1:][inside])]] = True
        fails[word[~self.agreed(token, np.full(len(token), -1))]] = True
        failed = np.flatnonzero(fails)
        if len(failed):
            short = failed[size[failed] > 0]
            starts = [self.start(raws[i], True) for i in short]
            sizes = np.array([len(s) for s in starts], dtype=np.int64)
            again, merged = self.merge_many(np.array([x for s in starts for x in s], dtype=np.int64), sizes)
            fine = ~fails[word]
            words_, tokens_ = [word[fine], short[again]], [token[fine], merged]
            for i in failed[size[failed] == 0]:
                merged = self.merge_long(self.start(raws[i], True))
                words_.append(np.full(len(merged), i))
                tokens_.append(np.array(merged, dtype=np.int64))
            word, token = np.concatenate(words_), np.concatenate(tokens_)
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        self.exact_words += len(failed)
        return token, np.searchsorted(word, np.arange(len(words) + 1))

    def split(self, text: str) -> list[str]:
        if not text.isascii() and self.beyond_latin(text):
            # letters and marks of newer scripts differ between Unicode versions: ask the library, by character
            marked = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.byte_of[c] for c in w).decode() for w, _ in marked]
        return self.find(unicodedata.normalize("NFC", text).lower())

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > WORD_CACHE or self.cached_bytes > CACHE_BYTES:
            self.words, self.ids, self.shown, self.cached_bytes = {}, [], [], 0
            new = list(words)
        self.cached_bytes += sum(map(len, new))
        token, cuts = self.encode_words(new)
        self.words.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        raw, shown, cuts = token.astype("<u4").tobytes(), [self.strings[i] for i in token.tolist()], cuts.tolist()
        self.ids += [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]
        self.shown += [" ".join(shown[i:j]) for i, j in zip(cuts, cuts[1:])]

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian uint32 and their decoded text: the tokens with spaces between."""
        parts: list[list] = []
        marked = []
        for i, t in enumerate(texts):
            if t and "<|" in t and any(s in t for s in self.special):
                marked.append(i)
                parts.append([])
            else:
                parts.append(self.split(t) if t else [])
        special = {i: self.split_special(texts[i]) for i in marked}
        special = {i: [x if x in self.special else self.split(x) for x in xs] for i, xs in special.items()}
        self.learn({*itertools.chain(*parts), *(w for xs in special.values() for x in xs if isinstance(x, list) for w in x)})
        words, ids, shown = self.words, self.ids, self.shown
        out = []
        for p in parts:
            at = [words[w] for w in p]
            out.append((b"".join([ids[k] for k in at]), " ".join([shown[k] for k in at])))
        for i, xs in special.items():
            pairs = [
                p
                for x in xs
                for p in (
                    [(ids[words[w]], shown[words[w]]) for w in x]
                    if isinstance(x, list)
                    else [(np.array([self.special[x]], "<u4").tobytes(), x)]
                )
            ]
            out[i] = (b"".join(p[0] for p in pairs), " ".join(p[1] for p in pairs))
        return out

    def decode(self, ids) -> str:
        return " ".join(self.strings[i] for i in ids)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian uint32), decoded (their text).

    Null and empty texts have no ids. Added tokens written out in a text get their ids, as in the library. Texts of any length are
    encoded whole; rows may repeat; other columns are not looked at.
    """
    path = vocabulary or default_vocabulary()

    def encoded(batches):
        import pyarrow as pa

        bpe = word_bpe(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, lambda t: len(t or "") + 64, CHARS_AT_ONCE):
                pairs = bpe.encode_batch(texts[i:j])
                columns = [b.column(0).slice(i, j - i), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        encoded, f"doc_id {kind}, ids binary, decoded string"
    )


def bpe_decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a column ``decoded`` for binary ids (little-endian uint32); null ids decode to null, and a column of that name is replaced."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def shown(ids):
        bpe = word_bpe(path)
        return ids.map(lambda b: None if b is None else bpe.decode(np.frombuffer(b, "<u4").tolist()))

    return df.withColumn("decoded", shown(F.col(ids_col)))


def op9_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
