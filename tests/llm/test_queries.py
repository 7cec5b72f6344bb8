"""Every registered query of the corpus operators on the smallest tables, its contract's columns held against plain Python or DuckDB."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tintframe.llm import html_extract, packing, queries, secrets, training_order

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def article(page):
    """The article's blocks by the page's own tags, in plain steps: its noise parts cut out, markup for lines, references decoded."""
    found = re.search("<article>(.*)</article>", page or "", re.S)
    blocks = html_extract.leaf_blocks(page)
    labels = html_extract.weak_labels(blocks)
    text = "\n".join(b.text for b, k in zip(blocks, labels) if k) if found else ""
    for block in text.split("\n"):  # each block's words stand in the article in that order
        assert not found or " ".join(block.split()[:3]) in " ".join(html.unescape(re.sub("<[^>]*>", "", found[1])).split())
    return text


def test_op1(spark):
    import pyarrow.parquet as pq

    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = rows(spark, "op1_html_extract")
    assert sorted(got.page_id) == sorted(pages) and got.n_chars.tolist() == got.text.map(len).tolist()
    assert got.url.tolist() == [pages[i]["url"] for i in got.page_id]
    assert got.text.tolist() == [article(pages[i]["html"]) for i in got.page_id]


def test_articles_of_other_layouts(spark):
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    crf = html_extract.Crf.train(html_extract.labelled_pages(pages))
    div = [html_extract.main_text(p.replace("<article", "<div").replace("</article>", "</div>"), crf) for p in pages]
    assert sum(t == article(p) for t, p in zip(div, pages)) >= 0.9 * len(pages)
    para = "The river ran past the old mill, and the miller watched it every day. Nobody knew where it went after that."
    body = f"The mill\n{para}\n{para} So on."
    layouts = {
        f"<p>{para}</p><p>{para} So on.</p>": f"{para}\n{para} So on.",
        f"<html><body><div><h1>The mill</h1><p>{para}<p>{para} So on.</div></body></html>": body,
        f"<h1>The mill</h1><p>{para}</p><p>{para} So on.</p>": body,
        f"{para}\n\n{para}": f"{para} {para}",
        f"<div><div>{para}</div></div>": para,
        "<nav><ul><li><a href=1>Home</a></li></ul></nav>": "",
        "<footer><p>All rights reserved.</p></footer>": "",
        "": "",
    }
    assert [html_extract.main_text(p, crf) for p in layouts] == list(layouts.values())
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, next(iter(layouts))), (2, None)], "page_id long, html string").withColumns({c: F.lit("mine") for c in ("h", "n", "text", "url")})
    out = html_extract.extract_main_text(df, html_extract.train_extractor(df.filter("page_id = 1")), out_col="found").orderBy("page_id").collect()
    assert [(r.found, r.h, r.text) for r in out] == [(layouts[next(iter(layouts))], "mine", "mine"), ("", "mine", "mine")]


def test_op2(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op2_best_fit_packing")
    for i, part in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tk.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert list(part.piece) == list(range(len(part))) and list(part.start) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        assert len(part) == -(-len(ids) // 1024) and (part.length[1:] == 1024).all()
        assert part.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length)]
    assert set(got.doc_id) == set(documents)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 1024
    counts = Counter(got.length.tolist())
    assert packing.lower_bound(counts, 1024) <= got.sequence_id.nunique() <= sum(c for _, c in packing.best_fit(counts, 1024))


def test_bins_reach_the_bound_where_best_fit_does_not():
    rng = np.random.default_rng(5)
    counts = Counter(rng.integers(20, 700, 900).tolist())
    bins, fit, bound = (sum(c for _, c in packing.bin_completion(counts)), sum(c for _, c in packing.best_fit(counts, 1024)), packing.lower_bound(counts, 1024))
    assert bound <= bins < fit


def test_op3(spark, documents):
    assign, kinds = re.compile(secrets.ASSIGN, re.A), ("assign", "access", "hex")
    got = rows(spark, "op3_secret_scan")
    assert set(got.doc_id) == set(documents)
    for r in got.itertuples():
        t = documents[r.doc_id]["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans = sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])
        shown = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(",")) | {""}


def test_op4(spark, documents):
    got = rows(spark, "op4_sharding")
    assert set(got.law) == {"rows"} and sorted(got.doc_id) == sorted(documents) and got.grown_shard.isna().all()
    sizes = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    for r in got.itertuples():
        raw = (documents[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_op5(spark, documents):
    got = rows(spark, "op5_training_order")
    assert sorted(got.slot) == list(range(len(got))) and set(got.doc_id) == set(documents)
    assert (got.shard == got.slot // training_order.SHARD_ROWS).all() and (got.row == got.slot % training_order.SHARD_ROWS).all()
    ordered = got.sort_values(["doc_id", "piece"])
    for _, part in ordered.groupby("doc_id"):
        assert list(part.start) == [0, *np.cumsum(part.length)[:-1]]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_op8(spark, documents):
    got = rows(spark, "op8_language_id")
    assert set(got.doc_id) == set(documents) and got.score.between(0, 1).all()
    known = {r["lang"] for r in documents.values() if r["lang"] is not None}
    held, right = 0, 0
    for r in got.itertuples():
        d = documents[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in known | {"und"}
        if r.held_out and letters and d["lang"]:
            held, right = held + 1, right + (r.lang_pred == d["lang"])
    assert held > 20 and right >= 0.95 * held


def test_op9(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.no_truncation()
    tk.no_padding()
    got = rows(spark, "op9_bpe_roundtrip")
    assert set(got.doc_id) == set(documents)
    for r in got.itertuples():
        ids = tk.encode(documents[r.doc_id]["text"] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_markov_finds_planted_strings(spark, documents):
    """Recall and false finds of the models on strings planted in the test documents, half of whose ids are null."""
    import base64
    import random

    draw = random.Random(8)
    makers = [
        lambda: "".join(draw.choice("0123456789ABCDEF") for _ in range(draw.randint(20, 40))),
        lambda: base64.b64encode(draw.randbytes(draw.randint(18, 40))).decode().rstrip("="),
        lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(draw.randint(20, 40))),
        lambda: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(draw.randint(20, 40))),
    ]
    data, planted = [], {}
    for k, (i, r) in enumerate(sorted(documents.items())):
        words = (r["text"] or "").split(" ")
        own = makers[k % 4]()
        at = draw.randint(0, len(words))
        data.append((k, None if k % 2 else i, " ".join([*words[:at], own, *words[at:]])))
        planted[k] = own
    df = spark.createDataFrame(data, "row long, doc_id long, text string").repartition(4)
    found = secrets.find_secrets(df, "text", secrets.trained(df)).collect()
    caught, other, tokens = 0, 0, 0
    for r in found:
        texts = [r.text[s["start"] : s["stop"]] for s in r.markov_spans]
        caught += planted[r.row] in texts
        base = [(s["start"], s["stop"]) for s in r.base_spans]
        other += sum(t != planted[r.row] and not any(a < s["stop"] and s["start"] < b for a, b in base) for t, s in zip(texts, r.markov_spans))
        tokens += len(re.findall(r"[A-Za-z0-9+/_.=-]{16,}", r.text)) - 1
    assert caught >= 0.98 * len(data) and other <= 0.02 * max(tokens, 50), (caught, other, tokens)


def test_words_that_polynomial_hashes_confuse(spark):
    from tintframe.llm import jaccard

    thue = "ab"
    while len(thue) < 1 << 17:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [t for n in (1024, 4096, 65536) for t in (thue[:n], thue[n : 2 * n])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard.jaccard_groups(df).collect()) == list(range(6))
    assert jaccard.drop_near_copies(df).count() == 6


def test_op8_by_plain_steps(spark, documents):
    """Every prediction and score, from trigrams counted in dictionaries and vectors multiplied one by one."""
    from tintframe.llm import langid

    letters, known = langid.letter_vectors().astype(np.int64), {}

    def kind(ch):
        if not ch.isalpha():
            return 0
        low = ord(ch.lower()[0])
        return low - 0x40 if low < 0x250 else 528 + (low * 2654435761 >> 7) % (langid.CLASSES - 528)

    def grams(text):
        codes = [0]
        for ch in text or "":
            k = kind(ch)
            if k or codes[-1]:
                codes.append(k)
        codes += [0] if codes[-1] else []
        return Counter(g for g in zip(codes, codes[1:], codes[2:]) if g[1] or (g[0] and g[2]))

    def vector(counts):
        out = np.zeros(letters.shape[1])
        for g, n in counts.items():
            if g not in known:
                known[g] = np.roll(letters[g[0]], 2) * np.roll(letters[g[1]], 1) * letters[g[2]]
            out += np.sqrt(n) * known[g]
        return out

    counts = {i: grams(r["text"]) for i, r in documents.items()}
    totals = {}
    for i, r in documents.items():
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            totals.setdefault(r["lang"], Counter()).update(counts[i])
    prototypes = {lang: vector(c) for lang, c in sorted(totals.items())}
    for r in rows(spark, "op8_language_id").itertuples():
        own = vector(counts[r.doc_id])
        if not counts[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cos = {lang: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for lang, v in prototypes.items()}
        best = max(cos.values())
        assert abs(r.score - min(max(best, 0), 1)) < 1e-4 and cos[r.lang_pred] > best - 1e-6
