"""Very long words, texts and pages, and odd layouts: bounded time and memory, results as for short ones."""

import re
import time

import numpy as np
import pytest

from tintframe.llm import bpe, embedding_dedup, html_extract, langid, secrets


def test_long_words_merge_as_the_library_merges_them():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    tk, own = Tokenizer.from_file(path), bpe.word_bpe(path)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshr"), n)) for n in (257, 3000, 20_000)] + ["ab" * 5000, "=" * 4001, "é" * 3000]
    for w, (ids, _) in zip(words, own.encode_batch(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(w, add_special_tokens=False).ids
    began = time.time()
    own.encode_batch(["".join(rng.choice(list("etaoinshrdlu"), 300_000))])
    assert time.time() - began < 60


def test_vectors_of_a_long_text_are_those_of_its_trigrams(monkeypatch):
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 1000)
    monkeypatch.setattr(langid, "GRAMS_AT_ONCE", 100)
    letters = langid.letter_vectors(64)
    rng = np.random.default_rng(3)
    for text in ("".join(rng.choice(list("abcdé  ,\n漢字9"), 20_000)), " " * 3000 + "a" * 1500 + "!" * 2000, "ab" * 700 + " "):
        grams, n = np.unique(langid.trigrams([text])[1], return_counts=True)
        want = np.sqrt(n, dtype=np.float32) @ langid.gram_vectors(grams, letters).astype(np.float32)
        got, some = langid.text_vectors([text], letters)
        assert some.all() and np.allclose(got[0], want, atol=1e-2)
    many = ["".join(rng.choice(list("abcdefghijk "), 300)) for _ in range(5)]
    got, _ = langid.text_vectors(many, letters)
    assert np.allclose(got, np.concatenate([langid.text_vectors([t], letters)[0] for t in many]), atol=1e-2)
    assert not langid.text_vectors(["12 !", ""], letters)[1].any()


def test_many_secrets_in_one_text(spark):
    text = " ".join("0123456789abcdef" + "é" * (i % 3) for i in range(5000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    table = np.zeros(secrets.STATES**2)
    began = time.time()
    found = secrets.find_secrets(df, "text", table).first()
    assert [tuple(s) for s in found.base_spans] == [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    assert secrets.redact(df, "text", table).first().text == re.sub("[0-9a-f]{16,}", "[secret]", text)
    assert time.time() - began < 60


@pytest.mark.parametrize("page", ['<a title="' * 8000, "<div>x" * 8000 + "</p>" * 8000, "<i><div>" + "<b>" * 8000 + "x</i>" * 8000, "<span>" * 8000 + "<hr>" * 8000, "</script" * 20_000, "<" * 100_000, "<button>" * 5000 + "x</button>" * 5000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_extract.block_features(html_extract.leaf_blocks(page))
    assert time.time() - began < 5


def test_leaf_blocks_by_the_standard():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert texts("<p class=it's>Hello <b title=don't>bold</b> there</p>") == ["Hello bold there"]
    assert texts("<p>a<svg><text>no</text></svg>b <my-tag>c</my-tag></p>") == ["ab c"]
    assert texts("<p>a <button>Go</button> b <select><option>x<option>y</select> c</p>") == ["a b c", "Go", "x", "y"]
    assert texts("<p>1 < 2 &amp;&amp; 3 > 2 &lt;b&gt;<br>new</p>") == ["1 < 2 && 3 > 2 <b> new"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "1", "2", "3"]


def test_training_without_article_or_main(spark):
    rng = np.random.default_rng(9)
    words = [f"wort{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    rows, want = [], {}
    for i in range(80):
        parts = [text(5), *(text(int(rng.integers(15, 60))) for _ in range(int(rng.integers(2, 6))))]
        want[i] = "\n".join(parts)
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        rows.append((i, f'<body><nav><ul><li><a href="/">{text(1)}</a></li></ul></nav><div class="ad">{text(8)}</div><div>{body}</div><footer>&copy; {text(4)}</footer></body>'))
    df = spark.createDataFrame(rows, "page_id long, html string")
    crf = html_extract.train_extractor(df, sample_pages=50)
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df, crf).collect()}
    assert sum(got[i] == want[i] for i in want) >= 76
    same = spark.createDataFrame([(1, rows[0][1])] * 3000, "page_id long, html string")  # one page, many times
    assert html_extract.main_text(rows[0][1], html_extract.train_extractor(same, sample_pages=20)) == want[0]
    with pytest.warns(UserWarning, match="made pages only"):
        none = html_extract.train_extractor(df.filter("false"))
    assert html_extract.extract_main_text(df.filter("false"), none).count() == 0


def test_components_of_vectors(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.standard_normal((3, 16))
    near = lambda v: (v + 0.05 * rng.standard_normal(16)).tolist()
    rows = [(7, near(a), 1), (5, near(a), 1), (5, near(b), 1), (9, near(b), 1), (None, near(c), 2), (None, near(c), 2), (3, near(a), 2), (2, a.tolist(), None), (11, c.tolist(), 2), (12, c.tolist(), 2)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df = df.withColumns({x: F.lit(x) for x in ("cls", "rep", "n", "cluster", "key", "links", "h1", "kept")})
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()), key=str)
    want = [(7, 1, 5, False), (5, 1, 5, True), (5, 1, 5, True), (9, 1, 5, False), (None, 3, 11, False), (None, 3, 11, False), (3, 0, 3, True), (2, 0, 2, True), (11, 3, 11, True), (12, 3, 11, False)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=str)]
