"""Cases of the corpus operators that once got less than the whole job: the first review's findings."""

import pytest

from tintframe.llm import html_extract, packing, secrets, tokens, words


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_shingles_of_a_slice_of_few_words(n):
    import pyarrow as pa

    texts = ["a b c d e f".rsplit(" ", 6 - n)[0]] if n < 6 else ["a b c d e f"]
    offsets, hashes = words.shingle_sets(pa.array(texts), 5)
    assert offsets.tolist() == [0, max(1, n - 4)] and len(set(hashes.tolist())) == max(1, n - 4)
    # the same sets as in a slice with many other words
    more, among = words.shingle_sets(pa.array([*texts, "g h i j k l m n o"]), 5)
    assert among[: more[1]].tolist() == hashes.tolist()


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, " \t" * 600_000])
def test_long_runs_of_white_space_are_encoded(run):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    tk, own = Tokenizer.from_file(path), tokens.byte_level_encoder(path)
    for t in (run, f"a{run}b <|endoftext|>", f"{'word ' * 50_000}{run[:99_999]}x"):
        assert own(t) == tk.encode(t, add_special_tokens=False).ids


def test_secrets_of_one_case_and_around_base_spans(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    syllables = "con fig ur a tion man ag er help func val ue the or di na ry name some i den ti fier ex am ple read write ta ble list".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    corpus = spark.createDataFrame([(i, " ".join(word() for _ in range(80))) for i in range(200)], "doc_id long, text string")
    table = secrets.trained(corpus)
    secret = ["qzjxkvwpfhgtrbnmlsdc", "QZJXKVWPFHGTRBNMLSDC", "qzjxkvwp-fhgtrbnm-lsdcqwer", "Qzjxkvwpfhgtrbnmlsdc", "XqZ9vKw0123456789abcdefWqK7zR"]
    plain = ["-" * 40, "." * 40, "=" * 40, "_" * 20, "=-" * 12, "X" * 20, "configurationManager", "ordinary_identifier_name", "ORDINARY_IDENTIFIER_NAME", "CONFIGURATIONMANAGER"]
    df = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df, "text", table).collect()}
    assert [got[i] for i in range(len(secret))] == ["a [secret] b"] * len(secret)
    assert [got[len(secret) + i] for i in range(len(plain))] == [f"a {t} b" for t in plain]


def test_an_open_head_ends_and_fallback_content_is_seen():
    article = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>shown</object> here.</p><button>Go on</button></article>"
    want = ["Let x=1 be shown here.", "Go on"]
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    head = "<html><head><meta charset=utf-8><title>x</title><style>p{}</style><script>1</script>"
    for page in (f"{head}<body>{article}", f"{head}{article}", f"{head}</head><body>{article}", f"<head><template><p>no</p></template>{article}"):
        assert texts(page) == want
    assert texts(f"{head}plain words<p>more") == ["plain words", "more"]


@pytest.mark.parametrize(("counts", "room"), [({9: 1, 7: 2, 5: 1, 4: 2, 3: 1, 2: 2}, 16), ({8: 2, 3: 1}, 13), ({7: 2, 6: 1, 2: 3}, 23), ({11: 1, 6: 3, 1: 2}, 20)])
def test_fillings_equal_brute_force(counts, room):
    import itertools
    from collections import Counter

    items = sorted(Counter(counts).elements(), reverse=True)
    every = {c for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}

    def holds(bins, parts):
        return not parts or any(holds(bins[:i] + (b - parts[0],) + bins[i + 1 :], parts[1:]) for i, b in enumerate(bins) if b >= parts[0])

    want = {f for f in every if not any(g != f and holds(g, f) for g in every)}
    assert {f for f in packing.fillings(counts, room) if f is not None} == want


@pytest.mark.parametrize("n", [1, 2, 3, 100])
def test_fillings_of_four_parts_are_found(n):
    from collections import Counter

    counts = dict.fromkeys((401, 200, 151, 140, 132), n)
    plan = packing.bin_completion(counts)
    assert sum(c for _, c in plan) == n and Counter(x for p, c in plan for x in p * c) == Counter(counts)
